"""Operators for training-corpus preparation; nothing else in the library imports this subpackage."""
