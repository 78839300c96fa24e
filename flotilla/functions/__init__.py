"""Column expressions built from built-in Spark SQL functions, and fixed values."""
