"""A PySpark-native analytics engine for commercial data."""
