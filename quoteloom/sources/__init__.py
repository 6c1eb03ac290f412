"""Readers of captured payloads, and the listing view over the driver's tables."""
