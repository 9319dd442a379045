"""Column expressions shared by operators: text, vectors, hashes, ranks."""
