"""sifter: Spark-native analytics for captured tool output and text corpora."""
