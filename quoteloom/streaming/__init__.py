"""Logs that arrive over time."""
