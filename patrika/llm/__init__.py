"""Operators for training text and records. Nothing outside this package imports it."""
