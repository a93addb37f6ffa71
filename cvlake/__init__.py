"""PySpark-native résumé analytics, hybrid search and training-data operators."""
