"""Training-data operators: language-model scoring, extraction, language id, mixing, dedup, filters, search."""
