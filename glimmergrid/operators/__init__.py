"""Operators on feature tables: selection, search and duplicates."""
