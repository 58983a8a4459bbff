"""Training-data operators: fingerprints, deduplication, rules, pseudonyms, mixing, packing, sharding."""
