"""Column expressions: text, trigrams, full-text vectors, money, JSON fields."""
