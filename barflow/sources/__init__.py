"""Readers, writers and landing schemas."""
