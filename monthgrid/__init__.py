"""Spark-native analytics over monthly entity panels."""
