"""Operators on product tables: normalising, filtering, scoring, deduplication."""
