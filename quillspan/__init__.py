"""Spark-native engine for annotated address text: keys, spans, corpora, evaluation, inference."""
