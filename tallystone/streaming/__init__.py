"""Structured Streaming jobs; each has a batch twin with the same result."""
