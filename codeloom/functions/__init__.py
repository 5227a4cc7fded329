"""Column expressions: paths, text, symbol arrays."""
