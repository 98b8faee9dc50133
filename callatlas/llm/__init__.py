"""Training-data operators: filtering, deduplication, decontamination, tokenization and search over large corpora."""
