"""Readers, derived views and writers."""
