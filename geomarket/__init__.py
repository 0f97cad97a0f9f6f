"""Property-market and location analytics as plain Spark DataFrame operators."""
