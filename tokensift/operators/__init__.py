"""Operators: the inverted index, its catalogue, search, and eager aggregation."""
