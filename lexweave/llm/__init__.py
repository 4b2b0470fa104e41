"""Operators that prepare training text: filters, deduplication, scoring, mixing and sharding of large corpora."""
