"""Operators for preparing training data at scale: duplicates, quality, search, packing."""
