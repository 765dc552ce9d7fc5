"""Functions of the page-mining engine."""
