"""Column functions: bits, little-endian numbers, text rules and checksums."""
