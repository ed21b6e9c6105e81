"""Structured Streaming jobs over append-only call logs."""
