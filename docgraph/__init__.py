"""docgraph: a PySpark-native analytics engine for document collections."""
