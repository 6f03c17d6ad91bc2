"""Relational operators: a DataFrame in, a DataFrame out."""
