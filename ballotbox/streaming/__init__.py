"""Structured Streaming form."""
