"""Operators for large training-text corpora. Nothing outside this folder imports it."""
