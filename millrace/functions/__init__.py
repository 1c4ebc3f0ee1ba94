"""Column functions for text."""
