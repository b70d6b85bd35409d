"""Spark-native posting analytics, matching and corpus preparation."""
