"""Structured Streaming form of the change feed."""
