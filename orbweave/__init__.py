"""PySpark-native analytics over point series, raster cells, features, events and attribute tables."""
