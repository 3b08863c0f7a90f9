"""Exports that arrive over time."""
