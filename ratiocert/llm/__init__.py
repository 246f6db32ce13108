"""Operators for preparing training text: deduplication, filtering, redaction, counting, mixing and formatting."""
