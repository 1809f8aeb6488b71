"""Operators for training data made from logs, code and texts; nothing outside this package imports it."""
