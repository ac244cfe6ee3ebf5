"""Operators on training text: PII, conversations, source validity, history
deduplication, grouping, similarity search, encoding, mixing and splitting."""
