"""Training-data operators: deduplication, scoring, scanning, encoding and media columns."""
