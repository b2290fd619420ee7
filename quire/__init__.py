"""Batch document processing on Spark: layout markup, text cleaning, chapters and packages."""
