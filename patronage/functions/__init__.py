"""Column and row-filter helpers shared by the operators."""
