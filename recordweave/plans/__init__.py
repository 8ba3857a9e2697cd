"""Registered queries of the core, each with equivalent SQL."""
