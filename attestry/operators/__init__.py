"""Relational operators of the evidence engine."""
