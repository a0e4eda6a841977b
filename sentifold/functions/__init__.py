"""Column expressions: scalar formulas that stay inside whole-stage code generation."""
