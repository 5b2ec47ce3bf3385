"""Training-data operators: extraction, deduplication, scans, scoring, mixing, formatting."""
