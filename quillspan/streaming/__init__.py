"""Incremental operators and Structured Streaming queries."""
