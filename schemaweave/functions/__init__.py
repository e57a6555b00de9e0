"""Column functions over SQL text."""
