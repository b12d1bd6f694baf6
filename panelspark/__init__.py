"""panelspark: PySpark-native analytics over multi-instrument time-series panels."""
