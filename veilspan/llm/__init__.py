"""Training-data operators: near duplicates, scoring, filters, tokenizers. Nothing outside this package imports it."""
