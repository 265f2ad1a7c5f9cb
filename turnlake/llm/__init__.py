"""Training-data operators: tokenising, deduplication, quality, mixing and formatting."""
