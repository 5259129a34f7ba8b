"""A Spark-native engine that finds, masks, scores and restores personal data."""
