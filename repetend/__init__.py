"""repetend: a Spark-native engine for periodic structure in symbol sequences."""
