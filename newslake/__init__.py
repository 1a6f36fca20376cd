"""A PySpark-native engine for headline archives (see README.md)."""
