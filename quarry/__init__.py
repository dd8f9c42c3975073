"""quarry: Spark-native analytics for building, auditing and evaluating large text corpora."""
