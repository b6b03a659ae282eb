"""Iterated algorithms, experiments and the catalogue of queries."""
