"""Operators on texts and records for training data; nothing else in the library imports them."""
