"""Spark-native scanning and masking of sensitive text."""
