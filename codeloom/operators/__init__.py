"""Relational operators over the files and imports DataFrames."""
