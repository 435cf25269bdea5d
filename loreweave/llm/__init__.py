"""Training-data operators: deduplication, extraction, sharding, masking, packing and archives."""
