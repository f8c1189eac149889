"""Column functions: strings in, Spark columns out. No Python runs per row."""
