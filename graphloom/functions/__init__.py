"""Column functions: spans and lines, numbers, hashes."""
