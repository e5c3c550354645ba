"""Report assembly: many small results of one scan as one document."""
