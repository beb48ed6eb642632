"""Operators that prepare training data."""
