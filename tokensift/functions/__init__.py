"""Column functions: the analyzer and the token predicates."""
