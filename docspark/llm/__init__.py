"""Operators for preparing training text: mixing, secrets, language models, deduplication, token files."""
