"""Whole jobs: compositions of operators and formulas from input tables to published tables."""
