"""Training-data operators: de-duplication, filtering, formatting, mixing, tokenising and search."""
