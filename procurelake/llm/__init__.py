"""Operators that prepare training text.  Nothing outside this package imports it."""
