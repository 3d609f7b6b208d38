"""Column functions: text, numbers, arrays."""
