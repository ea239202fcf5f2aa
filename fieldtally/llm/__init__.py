"""Training-data operators: filtering, near-duplicates, scoring, sharding, token counts and packing."""
