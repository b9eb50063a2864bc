"""Structured Streaming entry points (an extension: batches arrive as files)."""
