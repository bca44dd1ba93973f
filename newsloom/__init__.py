"""A PySpark-native engine for collecting, curating and ranking news articles."""
