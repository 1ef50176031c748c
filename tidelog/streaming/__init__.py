"""Structured Streaming operators of the engine."""
