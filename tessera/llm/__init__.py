"""Operators for training-data pipelines over documents; nothing else in the library imports this package."""
