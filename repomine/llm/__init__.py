"""Preparing text for training: ten operators on documents, pages and conversations, and their queries."""
