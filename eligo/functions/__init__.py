"""Column functions: text, lists, numbers."""
