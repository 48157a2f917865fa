"""Vellum: a Spark-native engine for corpora of long documents."""

__version__ = "0.1.0"
