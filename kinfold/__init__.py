"""kinfold: a Spark-native entity-resolution engine."""
