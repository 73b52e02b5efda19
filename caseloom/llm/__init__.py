"""Operators for cleaning corpora of training text. Nothing else in the library imports this subpackage."""
