"""Incremental bars and positions with Structured Streaming."""
