"""JSON, HTML and text."""
