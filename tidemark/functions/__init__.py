"""Column builders and scalar formulas."""
