"""Structured Streaming jobs over the prediction log and over arriving texts."""
