"""Spark-native analytics of personal data in text."""
