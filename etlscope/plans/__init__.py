"""From SQL text to fact tables."""
