"""docketforge: a Spark-native engine for large collections of legal documents."""
