"""Training-data operators: deduplication, mixing, sharding, tokens, language, media.

Nothing else in the library imports this subpackage.
"""
