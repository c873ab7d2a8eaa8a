"""Operators on extents, logs, traces, layers and checksums, as DataFrame functions."""
