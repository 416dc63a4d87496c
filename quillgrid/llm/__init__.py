"""Training-data operators: token files, media columns, sharding, near duplicates and the like."""
