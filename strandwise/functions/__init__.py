"""Column expressions: alphabets, hashes, qualities."""
