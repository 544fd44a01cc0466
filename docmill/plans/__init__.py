"""Whole-table plans: the lifecycle and the query catalogue."""
