"""Training-data operators: toxicity, scoring, search, de-duplication, tokens, privacy, shards."""
