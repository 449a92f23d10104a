"""Operators for text training data and very large numeric columns."""
