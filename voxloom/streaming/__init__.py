"""Structured Streaming over a folder."""
