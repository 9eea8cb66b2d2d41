"""Column functions: names, layers, types."""
