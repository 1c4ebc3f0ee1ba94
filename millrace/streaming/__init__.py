"""Structured Streaming forms of the screens."""
