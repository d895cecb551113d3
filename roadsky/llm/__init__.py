"""Operators for preparing training data: archives, secrets, copies, quality, tokens, search."""
