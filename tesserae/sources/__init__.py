"""Readers, writers and row routing."""
