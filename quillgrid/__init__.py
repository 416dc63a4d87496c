"""A Spark-native engine for report indicators."""
