"""Operators for building training corpora: sharding, dedup, cleaning, packing."""
