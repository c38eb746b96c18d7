"""Training-data operators: mixing, language-model scoring, media, deduplication, licences, quality, PII, tokenizing."""
