"""Operators for preparing training data: filtering, deduplication, mixing, packing, sharding."""
