"""Column functions. All are compositions of built-in Spark functions: they stay in generated code."""
