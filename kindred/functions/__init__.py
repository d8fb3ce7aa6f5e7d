"""Column functions: text cleaning, accents, vectors."""
