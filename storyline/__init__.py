"""A PySpark-native news-intelligence engine: ingest, cluster, score, brief and search."""
