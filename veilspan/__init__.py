"""Spark-native de-identification data work: spans, decisions, audits, splits, redaction, leaderboards."""

__version__ = "0.1.0"
