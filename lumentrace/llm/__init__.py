"""Training-data operators: filtering, deduplication, search, formatting, packing and mixing."""
