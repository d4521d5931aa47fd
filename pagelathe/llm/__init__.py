"""Training-data operators: deduplication, decontamination, tokens, quality, toxicity, secrets, chats and main text."""
