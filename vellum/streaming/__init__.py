"""Comparing pages as they arrive."""
