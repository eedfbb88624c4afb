"""Operators for preparing training corpora: quality, language, toxicity, duplicates, mixing, packing, sharding."""
