"""Operators for training-data problems on text; nothing outside imports this."""
