"""Column expressions: time parts, parsing, labels."""
