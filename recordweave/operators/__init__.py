"""Relational operators composed from DataFrame built-ins."""
