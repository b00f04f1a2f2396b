"""Column functions: text handling and the scoring formulas."""
