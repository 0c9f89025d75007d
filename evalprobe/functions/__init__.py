"""Column functions: parsing, normalising and formatting of answers, texts, names and metrics."""
