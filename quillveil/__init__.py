"""Spark-native search, redaction and audit of text and page-layout tables."""
