"""Structured Streaming forms of recordings, admission and counters; their batch forms in `operators` are authoritative."""
