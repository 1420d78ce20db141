"""Training-data operators: cleaning, deduplication, scoring, mixing and sharding of documents."""
