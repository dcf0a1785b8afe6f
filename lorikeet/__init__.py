"""Lorikeet: Spark-native analytics for speech-practice data."""
