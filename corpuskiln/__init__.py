"""A PySpark-native engine for corpus processing and text analytics."""
