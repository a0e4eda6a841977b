"""Relational operators that Spark has no single function for."""
