"""Incremental drivers on Structured Streaming."""
