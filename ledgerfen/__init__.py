"""Spark-native analytics over key-value mutation logs."""
