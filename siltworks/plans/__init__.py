"""Siltworks plans."""
