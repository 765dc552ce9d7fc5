"""Plans of the page-mining engine."""
