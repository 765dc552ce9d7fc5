"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it. Every module holds one operator
with its general interface and the thin ``opN_*`` query that applies it to a
whole table.
"""
