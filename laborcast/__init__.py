"""Labour-market analytics as lazy PySpark DataFrame operators."""
