"""Operators for preparing text corpora for training, and their queries."""
