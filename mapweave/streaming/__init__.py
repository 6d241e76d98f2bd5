"""Conversion of arriving files."""
