"""gleanery: PySpark-native analysis of heterogeneous text documents."""
