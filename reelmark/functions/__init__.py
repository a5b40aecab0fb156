"""Column functions: names and paths, codes, time, text."""
