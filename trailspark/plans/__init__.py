"""Whole query modes."""
