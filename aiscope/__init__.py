"""Spark-native inventory, risk, policy and corpus analytics for AI components."""
