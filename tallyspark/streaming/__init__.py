"""Streaming of the filing analytics engine."""
