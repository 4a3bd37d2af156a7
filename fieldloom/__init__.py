"""A PySpark-native engine for gridded, spatial and framed binary data."""
