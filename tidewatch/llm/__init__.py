"""Operators for preparing large text corpora: sketches, deduplication, quality
and toxicity filters, archives, packing and tokenization."""
