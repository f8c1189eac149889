"""Readers and writers of the corpus files."""
