"""Operators for building training data. Nothing outside of this package imports it."""
