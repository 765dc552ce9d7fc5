"""Sources of the page-mining engine."""
