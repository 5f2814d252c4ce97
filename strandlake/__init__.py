"""Positional signal analytics as DataFrame plans."""
