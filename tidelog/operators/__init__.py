"""Dataflow operators of the engine."""
