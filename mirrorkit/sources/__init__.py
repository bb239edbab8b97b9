"""Scans over message, body, folder and destination tables, and the state tables."""
