"""Structured Streaming forms of the event plans."""
