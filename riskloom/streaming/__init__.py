"""Structured Streaming forms of the drift operators."""
