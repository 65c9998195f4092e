"""Operators for preparing training data: mixing, packing, scoring, privacy, extraction, search, languages, copies and shards."""
