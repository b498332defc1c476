"""Training-data operators: packing, tokens, fingerprints, PII, deduplication, URLs, chat, toxicity."""
