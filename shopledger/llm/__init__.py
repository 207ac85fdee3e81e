"""Operators for building training corpora at scale; nothing outside imports this."""
