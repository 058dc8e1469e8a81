"""Incremental folding of batches into a product table."""
