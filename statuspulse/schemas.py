"""Explicit schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_status_node = T.StructType([T.StructField("status", T.StringType())])
_summary = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        # a map, so that outlets explode whatever their number
        T.StructField("port_status", T.MapType(T.StringType(), _status_node)),
    ]
)

SNAPSHOT_DOCUMENT = T.ArrayType(
    T.StructType(
        [
            T.StructField("time", T.StringType()),
            T.StructField("summaries", T.ArrayType(_summary)),
        ]
    )
)

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
ARCHIVE_FILES = "path string, content binary"

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

POLLS = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("avail", T.LongType()),
        T.StructField("in_use", T.LongType()),
        T.StructField("unknown", T.LongType()),
        T.StructField("total", T.LongType()),
    ]
)
