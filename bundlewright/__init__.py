"""Batched retrieval and context selection on PySpark DataFrames."""

__version__ = "0.1.0"
