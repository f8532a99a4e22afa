"""Operators for preparing training text: quality, dedup, mixing, tokens, search, archives."""
