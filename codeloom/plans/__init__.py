"""Compositions of operators: indexing, the tool surface, text views."""
