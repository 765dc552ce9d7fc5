"""Operators of the page-mining engine."""
