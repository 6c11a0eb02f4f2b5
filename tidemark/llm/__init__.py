"""Operators over training-data tables: documents, pages, conversations and embeddings."""
