"""Column builders: predicates, text rendering, SQL table functions."""
