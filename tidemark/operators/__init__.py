"""Batch operators on the documented tables."""
