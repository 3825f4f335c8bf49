"""Spark-native analytics for corpora of machine-transcribed documents."""
