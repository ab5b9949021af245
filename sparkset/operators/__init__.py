"""Operators on ordered datasets."""
