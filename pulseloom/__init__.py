"""Spark-native engine for noisy sensor streams, switch events and their evaluation."""
