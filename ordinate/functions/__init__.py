"""Selectors: how callers name columns and expressions."""
