"""Readers, writers and stored dataset bundles."""
