"""A PySpark-native analytics engine: SQL with recursion and Python functions, a relational language, and DataFrame, bag and array operators."""
