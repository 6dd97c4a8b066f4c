"""Status-log analytics as PySpark DataFrame operators."""
