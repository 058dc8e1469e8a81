"""Scalar functions on columns: text, prices, SKUs, quantities, URLs, colours."""
