"""Column functions: every one is a plain built-in Spark expression."""
