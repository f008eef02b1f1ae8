"""Column functions: text cleaning, parsing, comparison, quality rules."""
