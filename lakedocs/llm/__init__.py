"""Training-data operators: token files, packing, sharding, deduplication, scoring."""
