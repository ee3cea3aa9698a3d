"""Queries over the engine's operators."""
