"""Operators for preparing training data at scale; nothing else in gristmill imports this subpackage."""
