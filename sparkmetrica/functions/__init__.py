"""Column functions: they build Spark expressions and run nothing."""
