"""Scalar functions: key order, ranges, hashing."""
