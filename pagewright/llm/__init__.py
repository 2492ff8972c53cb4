"""Training-data operators: deduplication, classification, extraction, packing, tokenization, search."""
