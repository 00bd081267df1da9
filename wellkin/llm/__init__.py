"""Training-data operators: deduplication, filters, extraction, scoring, packing."""
