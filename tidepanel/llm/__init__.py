"""Operators for preparing text, vectors and media as training data."""
