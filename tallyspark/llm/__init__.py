"""Training-data operators: quality, safety, privacy, deduplication, search, packing and sharding."""
