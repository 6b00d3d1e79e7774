"""Training-data operators: deduplication, scoring, filtering, packing, formatting and archives."""
