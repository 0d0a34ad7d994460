"""Readers of corpora, logs and catalogues, and their writers."""
