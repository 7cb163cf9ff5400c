"""Containers, analyses and results: the public surface over the operators."""
