"""Operators of a training-data pipeline: filtering, deduplication, extraction, search, archives, sharding and mixing."""
