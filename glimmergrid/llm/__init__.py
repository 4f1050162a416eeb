"""Operators that prepare text and vectors for training large models."""
