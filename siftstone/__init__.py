"""Spark-native bulk inspection of binary files and text corpora."""
