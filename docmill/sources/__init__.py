"""Readers of stored and fetched sources."""
