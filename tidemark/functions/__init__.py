"""Column expressions: JSON, text, time and key hashing."""
