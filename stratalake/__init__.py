"""Extent, mapping-log, trace and integrity analytics on Spark DataFrames."""
