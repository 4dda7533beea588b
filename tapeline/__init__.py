"""tapeline: a PySpark-native analytics engine for time-ordered market-style data."""
