"""Corpus readers and table writers."""
