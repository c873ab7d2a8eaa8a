"""Schemas and limits of the data model.

A segment maps `length` sectors of 512 bytes from logical sector `offset` to sector `moffset` of a
layer's data, or reads as zeroes where `zeroed`.  The limits are fixed values of the formats; a device's
live index and log have at most MAX_INDEX and MAX_LOG rows, which bounds every window over one device.
"""

from __future__ import annotations

from pyspark.sql import types as T

SECTOR = 512
#: Fixed values of the formats.
MAX_OFFSET = (1 << 50) - 1
MAX_LENGTH = (1 << 14) - 1
MAX_MOFFSET = (1 << 55) - 1
INVALID_OFFSET = MAX_OFFSET
DATA_START = 8
REGION = 4096
MAX_INDEX = 1_000_000
MAX_LOG = 4_000_000
MAX_LAYERS = 255
MAX_READ = 1 << 20
EXTENT_BYTES = 64 * 1024

SEGMENT = T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("moffset", T.LongType()), T.StructField("zeroed", T.BooleanType()), T.StructField("tag", T.IntegerType())])
LAYER_SEGMENT = T.StructType([T.StructField("device", T.LongType()), T.StructField("layer", T.IntegerType()), *SEGMENT.fields[:4]])
MAPPING_LOG = T.StructType([T.StructField("device", T.LongType()), T.StructField("seq", T.LongType()), *SEGMENT.fields[:4]])
TRACE = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("op", T.StringType()), T.StructField("layer_index", T.LongType()), T.StructField("count", T.LongType()), T.StructField("offset", T.LongType())])
REQUEST = T.StructType([T.StructField("device", T.LongType()), T.StructField("request", T.LongType()), T.StructField("op", T.StringType()), T.StructField("start_sector", T.LongType()), T.StructField("nr_sectors", T.LongType())])
LAYER_ENTRY = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("mode", T.IntegerType()),
        T.StructField("uid", T.LongType()),
        T.StructField("gid", T.LongType()),
        T.StructField("mtime_s", T.LongType()),
        T.StructField("mtime_ns", T.IntegerType()),
        T.StructField("link_target", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("logical", T.LongType()), T.StructField("stored", T.LongType()), T.StructField("length", T.LongType())]))),
        T.StructField("xattrs", T.MapType(T.StringType(), T.BinaryType())),
    ]
)
