"""Operators of a sequence, by family."""
