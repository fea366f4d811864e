"""Streams over the engine's logs."""
