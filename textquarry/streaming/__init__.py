"""Structured Streaming jobs that keep derived tables current."""
