"""A Spark-native data profiling engine."""
