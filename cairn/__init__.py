"""cairn: a Spark-native engine for operational knowledge bases."""
