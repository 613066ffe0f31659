"""A Spark-native engine for graph layouts, edge routes and packings of layouts."""
