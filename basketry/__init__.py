"""Retail purchase analytics as Spark DataFrame jobs."""
