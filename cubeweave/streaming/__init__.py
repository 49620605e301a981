"""Structured streaming over event tables."""
