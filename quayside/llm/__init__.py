"""Corpus operators for training data; optional: nothing outside imports this package."""
