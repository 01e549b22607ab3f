"""Siltstone: retrieval and corpus processing on PySpark DataFrames."""
