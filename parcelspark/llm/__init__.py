"""Training-data operators: filtering, deduplication, search, layout and language-model scoring."""
