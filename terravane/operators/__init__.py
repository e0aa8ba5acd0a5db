"""Relational operators over scene data."""
