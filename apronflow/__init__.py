"""Airport operations analytics as Spark DataFrame operators."""
