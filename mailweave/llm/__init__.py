"""Training-data operators: scoring, filtering, deduplication, mixing and packing of a document table."""
