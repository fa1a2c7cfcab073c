"""Training-data operators: filtering, deduplication, scoring, formatting and packing of text corpora."""
