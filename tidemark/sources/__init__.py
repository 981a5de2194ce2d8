"""Readers, name resolution and writers."""
