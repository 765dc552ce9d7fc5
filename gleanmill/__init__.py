"""Spark-first engine for mining structured records out of fetched web result pages."""
