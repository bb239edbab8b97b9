"""Structured Streaming: arrivals, deduplication and membership feeds."""
