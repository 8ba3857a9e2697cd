"""Scalar functions: text normalisation and string similarity."""
