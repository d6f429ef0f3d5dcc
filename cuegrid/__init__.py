"""Spark-native analytics over time-stamped token streams and subtitle cues."""
