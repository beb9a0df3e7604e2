"""Spark-native record linkage: text normalisation, blocking, pair features, scoring, set decision and metrics."""
