"""Operators that prepare training text: deduplication, filters, mixing, scoring and token files."""
