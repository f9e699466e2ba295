"""PySpark-native engine for map points of interest."""
