"""A PySpark-native analytics engine for timestamped event streams."""
