"""Structured Streaming forms of the batch phases."""
