"""Operators for training-data pipelines: chat, dedup, fingerprints, packing, search, toxicity, tokens and PII."""
