"""Relational twins of the operators."""
