"""Stores, caches and the Spark data source that read chunked arrays."""
