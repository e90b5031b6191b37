"""Spark-native engine for defeasible-reasoning datasets."""
