"""A Spark-native engine for analysing code corpora and preparing text corpora."""

__version__ = "0.1.0"
