"""Operators on route tables."""
