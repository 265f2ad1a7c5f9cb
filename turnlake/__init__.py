"""Spark-native analytics over archives of agent conversations."""
