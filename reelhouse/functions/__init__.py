"""Column functions: paths and names, dates, hashes and escapes."""
