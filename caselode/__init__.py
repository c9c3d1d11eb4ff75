"""caselode: PySpark-native analytics over retrieval corpora, answer logs and training data."""
