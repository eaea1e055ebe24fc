"""Column expressions: text cleaning, tokens, vectors, numbers."""
