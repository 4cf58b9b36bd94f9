"""Operators for large text corpora: cleaning, near-duplicates, scoring, mixing and sharding of training data."""
