"""Queries: operators applied to the tables, with their SQL."""
