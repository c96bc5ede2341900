"""Operators for preparing training text: filters, extraction, deduplication, mixing."""
