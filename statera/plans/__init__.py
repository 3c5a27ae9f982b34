"""Derived tables and the query registry."""
