"""Operators that prepare training data: filtering, deduplication, decontamination, packing."""
