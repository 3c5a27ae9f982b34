"""Readers of statement files and sinks of results."""
