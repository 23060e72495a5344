"""Operators for text and vector training data. Nothing outside this folder imports it."""
