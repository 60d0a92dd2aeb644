"""Ordered-series, interval, vector and label analytics as PySpark DataFrame operators."""
