"""Spark-native analytics over file trees, block containers and text corpora."""
