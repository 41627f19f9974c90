"""Operators for building training corpora: quality, mixing, language, duplicates, search, scoring, tokens."""
