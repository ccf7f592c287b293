"""Siltworks sources."""
