"""Spark-native catalog engine for scientific-imaging archives."""
