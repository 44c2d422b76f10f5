"""millrace: Spark-native dataset curation, evaluation and observation streams."""
