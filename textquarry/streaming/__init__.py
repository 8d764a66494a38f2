"""Structured Streaming uses of the stateless operators."""
