"""Operators over collections: registry, retrieval, context, chat, administration."""
