"""Spark-native analytics over technical drawings, their text, and text corpora."""
