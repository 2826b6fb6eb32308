"""Composite jobs, bindings to the given tables, and the query registry."""
