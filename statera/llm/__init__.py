"""Operators for preparing training corpora. Nothing else in statera imports this subpackage."""
