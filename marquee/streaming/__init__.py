"""Structured Streaming forms of the keyed-state operators."""
