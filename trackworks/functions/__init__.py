"""Text parsing functions."""
