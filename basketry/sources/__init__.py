"""Schemas, readers, writers and the shared staging folder."""
