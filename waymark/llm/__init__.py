"""Training-data operators: dedup, decontamination, search, extraction, mixing and sharding."""
