"""Readers, writers, catalogues and loaders."""
