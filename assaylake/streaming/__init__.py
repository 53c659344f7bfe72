"""Structured Streaming and incremental jobs over the same operators."""
