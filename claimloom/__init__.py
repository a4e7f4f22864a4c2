"""Spark-native claim normalisation, linkage and analytics engine."""
