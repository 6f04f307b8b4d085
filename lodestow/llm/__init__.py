"""Training-data operators: quality, toxicity, tokenising, language models, deduplication, packing."""
