"""A Spark-first analytics engine for dated article collections."""
