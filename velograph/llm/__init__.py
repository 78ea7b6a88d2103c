"""Training-data operators: search, deduplication, mixing, packing, formatting, archives, classifiers."""
