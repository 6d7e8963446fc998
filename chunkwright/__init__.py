"""Chunkwright: chunked n-dimensional arrays as partitioned Spark relations."""

__version__ = "0.1.0"
