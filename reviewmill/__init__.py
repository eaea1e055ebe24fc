"""Product-review analytics as PySpark DataFrame operators."""
