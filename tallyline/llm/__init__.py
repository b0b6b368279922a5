"""Preparing text corpora for language-model training."""
