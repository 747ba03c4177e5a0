"""Readers, writers and SQL entry points."""
