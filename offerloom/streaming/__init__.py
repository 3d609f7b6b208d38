"""Offers as they arrive."""
