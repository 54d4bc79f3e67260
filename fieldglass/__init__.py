"""Spark-native analytics over federated sensor registries."""
