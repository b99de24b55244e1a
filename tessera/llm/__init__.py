"""Training-data operators: sharding, mixing, deduplication, packing, language, quality and privacy."""
