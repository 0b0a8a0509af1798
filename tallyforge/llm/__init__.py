"""Training-data operators: filtering, extraction, deduplication, scoring, mixing and packing."""
