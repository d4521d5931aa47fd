"""Queries and plans of several steps."""
