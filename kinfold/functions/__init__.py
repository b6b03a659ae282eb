"""Vector functions as Column expressions."""
