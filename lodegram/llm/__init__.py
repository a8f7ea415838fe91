"""Training-data operators: quality, safety, de-duplication, mixing, search and tokenization."""
