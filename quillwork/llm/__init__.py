"""Operators for preparing text collections."""
