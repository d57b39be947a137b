"""Training-data operators: dedup, tokenization, packing, filtering, extraction."""
