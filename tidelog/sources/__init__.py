"""Storage: the manifest, log segments, runs, byte formats."""
