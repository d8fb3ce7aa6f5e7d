"""Table operators: positions, terms, lemmas, vectors, top-k search."""
