"""Structured Streaming forms of the replay."""
