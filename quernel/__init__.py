"""quernel: a Spark-native retrieval, answer-verification and corpus engine."""
