"""Larger plans put together from the operators."""
