"""Training-data operators: cleaning, dedup, scoring, mixing, sharding, encoding."""
