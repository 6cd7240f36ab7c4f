"""Incremental forms of the daily stages on Structured Streaming."""
