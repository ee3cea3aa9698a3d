"""Streams of changes into a store."""
