"""A PySpark-native engine for archived mail and document corpora."""
