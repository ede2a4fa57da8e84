"""Streaming jobs over the same computations."""
