"""Training-data operators: deduplication, filtering, labelling, packing and sharding of documents."""
