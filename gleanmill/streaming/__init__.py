"""Streaming of the page-mining engine."""
