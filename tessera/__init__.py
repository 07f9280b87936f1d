"""tessera: a Spark-native analytics engine for catalogs of dataset metadata."""
