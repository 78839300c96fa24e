"""Operators for preparing language-model training data (URL filters, dedup, PII, mixing, ...)."""
