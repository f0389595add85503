"""Column-to-Column functions: text, polarity, numbers."""
