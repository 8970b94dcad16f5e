"""Operators on text and records for training data; nothing outside of this folder imports it."""
