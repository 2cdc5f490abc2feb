"""Structured Streaming into append-only datasets."""
