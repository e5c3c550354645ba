"""Readers: image headers to bronze rows, and tables to frames."""
