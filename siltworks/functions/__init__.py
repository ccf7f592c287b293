"""Siltworks functions."""
