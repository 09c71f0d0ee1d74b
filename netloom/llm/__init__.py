"""Operators on training data: documents, pages and conversations."""
