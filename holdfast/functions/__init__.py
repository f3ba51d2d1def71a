"""Column expressions. All are built-in Spark expressions; there is no UDF."""
