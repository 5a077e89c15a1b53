"""Operators for large training corpora: tokens, pages, toxicity, duplicates, secrets, neighbours, packing and chats."""
