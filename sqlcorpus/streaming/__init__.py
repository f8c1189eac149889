"""Streaming forms of the line reader, the rewrite and the plateau detector."""
