"""Operators for preparing training text: fingerprints, encoding, deduplication, filters, packing."""
