"""Readers, writers and generators of vector files."""
