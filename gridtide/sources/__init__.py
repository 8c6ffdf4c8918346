"""Readers, writers and model bundles."""
