"""Training-data operators: quality, tokens, mixing, sharding, near-duplicates, URLs, chat, toxicity, vectors, LM scores."""
