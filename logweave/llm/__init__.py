"""Operators for training data. Optional: the rest of the library does not import this package."""
