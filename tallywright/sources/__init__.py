"""Readers of corpora and prediction artifacts, and the JSON sink of results."""
