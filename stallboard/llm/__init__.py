"""Training-data operators: extraction, filtering, deduplication, mixing and output."""
