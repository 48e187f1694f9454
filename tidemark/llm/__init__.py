"""Operators for training-data corpora: filtering, scoring, deduplication, mixing, packing and output."""
