"""Operators for preparing language-model training data (see the README for the list)."""
