"""Whole jobs built from the operators: prepare, quality gate, analysis, report."""
