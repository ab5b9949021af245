"""Lazy and streaming datasets."""
