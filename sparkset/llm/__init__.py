"""Training-data operators: filters, deduplication, extraction, scoring and tokenisation of text tables."""
