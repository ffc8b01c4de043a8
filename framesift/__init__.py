"""Spark-native curation of large media catalogues and of training text."""
