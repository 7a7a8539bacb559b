"""Operators for training text: personal data, language, toxicity, duplicates, mixing, counts."""
