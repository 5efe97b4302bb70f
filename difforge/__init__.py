"""A PySpark-native engine for code-review analytics and training-data preparation."""
