"""Scalar and hash functions."""
