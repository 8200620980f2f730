"""Training-data operators: chat collapse, quality, deduplication, packing, scoring, URL rules and mixing."""
