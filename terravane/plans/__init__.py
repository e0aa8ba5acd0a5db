"""Registered queries: every operator applied to the stored tables."""
