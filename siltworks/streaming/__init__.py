"""Siltworks streaming."""
