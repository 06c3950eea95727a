"""Rows that arrive as a stream."""
