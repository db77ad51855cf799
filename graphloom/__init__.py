"""A PySpark-native engine for analytics over source-code property graphs."""
