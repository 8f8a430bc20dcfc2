"""Operators on solution tables and on raw feeds."""
