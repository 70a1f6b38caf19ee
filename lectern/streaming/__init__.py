"""Structured Streaming versions of ingestion, status tracking and voice sessions."""
