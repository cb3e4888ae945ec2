"""Corpus-scale detection, redaction, verification and audit of sensitive data on Spark."""
