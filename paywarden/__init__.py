"""Spark-native payment-metadata governance and analytics."""
