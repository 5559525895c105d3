"""Column functions: text normalization, match positions, dates."""
