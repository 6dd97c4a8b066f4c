"""Column expressions: time, text, codes."""
