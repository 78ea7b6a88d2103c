"""velograph: a Spark-native analytics engine for path networks."""
