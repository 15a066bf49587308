"""Queries over the given tables: adapters, the operators applied to them, and their SQL."""
