"""Spark-native analytics over security findings, labelled code corpora and their gates."""
