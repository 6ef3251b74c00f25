"""Operators for preparing training text: deduplication, filters, packing and counts."""
