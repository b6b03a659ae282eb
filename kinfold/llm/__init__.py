"""Operators for preparing training text, and the queries that apply them.

Nothing outside this subpackage imports it.  Every operator keeps the rows it
is given: a null text counts as an empty one, repeated rows are handled one by
one, an empty table gives an empty result, and an input column named like one
of the operator's own output columns is replaced by it.
"""
