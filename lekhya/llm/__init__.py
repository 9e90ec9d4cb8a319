"""Operators on training text; nothing outside this package imports it."""
