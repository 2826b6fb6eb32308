"""Incremental form of the hourly counts."""
