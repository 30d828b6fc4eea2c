"""Training-data operators: mixing, deduplication, formatting, language, privacy, counting, scoring."""
