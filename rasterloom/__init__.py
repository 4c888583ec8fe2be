"""A Spark-native engine for catalogs of tiled rasters."""
