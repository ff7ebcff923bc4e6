"""Operators for preparing training text: deduplication, filters, mixing, packing, search, WARC."""
