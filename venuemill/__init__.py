"""Venue analytics on PySpark: extract, resolve, score, rank and serve."""
