"""Operators of the filing analytics engine."""
