"""Operators over documents and chunks."""
