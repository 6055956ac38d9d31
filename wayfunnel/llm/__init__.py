"""Corpus operators for training data: search, deduplication, packing, tokenising, scanning and decontamination."""
