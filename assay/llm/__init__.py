"""Operators for preparing language-model training and evaluation data."""
