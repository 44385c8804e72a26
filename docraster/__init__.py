"""docraster: a PySpark-native engine for scanned page collections."""
