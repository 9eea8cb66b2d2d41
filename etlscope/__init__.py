"""PySpark-native engine for understanding SQL data pipelines."""
