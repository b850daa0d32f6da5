"""Incremental matching of records that arrive as a stream."""
