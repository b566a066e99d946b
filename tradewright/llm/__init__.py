"""Operators of a training-data pipeline: search, mixing, scoring, deduplication, language, links, tokens, quality, chats."""
