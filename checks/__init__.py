"""Queries on the supplied tables and their SQL twins."""
