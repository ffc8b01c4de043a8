"""Column functions: hashes, times, strings and small calculations."""
