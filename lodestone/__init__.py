"""A Spark-native engine for SQL analytics, data quality, search and training-data preparation."""
