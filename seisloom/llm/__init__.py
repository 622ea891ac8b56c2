"""Training-data operators: packing, deduplication, tokenisation, search and scoring over `documents` and `embeddings`."""
