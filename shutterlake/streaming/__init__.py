"""Structured Streaming over a landing folder of bronze rows."""
