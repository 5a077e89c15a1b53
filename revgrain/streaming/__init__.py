"""Structured Streaming jobs. Each has a batch form with the same result."""
