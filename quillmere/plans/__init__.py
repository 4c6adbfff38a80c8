"""Registered queries: each applies operators to the given tables."""
