"""Chained operators: the whole study."""
