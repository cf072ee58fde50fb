"""Training-data operators: scoring, detection, deduplication, mixing and packing of documents."""
