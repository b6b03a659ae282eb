"""Relational steps on attributed graphs."""
