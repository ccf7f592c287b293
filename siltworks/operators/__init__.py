"""Siltworks operators."""
