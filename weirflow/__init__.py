"""Typed map/reduce pipelines on PySpark DataFrames."""
