"""Hashing, similar pairs, cover."""
