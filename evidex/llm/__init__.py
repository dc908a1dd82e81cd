"""Operators for text and model training data; nothing outside imports this package."""
