"""Operators for preparing language-model training data at cluster scale."""
