"""Structured Streaming into the same idempotent write path."""
