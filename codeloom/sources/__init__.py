"""Readers and writers: trees, git text, rule files, Parquet tables."""
