"""Schemas and fixed codes shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import types as T

# They are part of the data format.
STATUS_UNPROCESSED = 1
STATUS_PROCESSED = 2
ACTION_CODES = {"insert": 0, "update": 1, "delete": 2}
UNKNOWN_ACTION = "unknown"
DEFAULT_TIME_ZONE = "Asia/Shanghai"

# One row-level change as it travels on the events topic; `data` is base64 text
# in JSON, which from_json decodes for a BINARY field.
EVENT_ENVELOPE = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)

# One transaction notice as it travels on the transactions topic.
TX_ENVELOPE = T.StructType(
    [
        T.StructField("time", T.LongType()),
        T.StructField("context", T.StringType()),
        T.StructField("gtid", T.StringType()),
    ]
)

# One change as a replication reader hands it over, as a JSON message. The row images
# are VARIANT, which keeps numbers, text and NULLs apart.
RAW_CHANGE = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("gtid_set", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("before", T.VariantType()),
        T.StructField("after", T.VariantType()),
    ]
)

EVENT_FIELDS = ["db", "table", "action", "gtid", "data"]

# Stored events, partitioned by (day, batch).
EVENT_TABLE = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("ingest_time", T.TimestampType()),
        T.StructField("day", T.StringType()),
        T.StructField("batch", T.StringType()),
    ]
)

# Status versions of transactions, partitioned by (writer, month). `seq` orders the
# versions of one transaction: the highest wins.
TX_TABLE = T.StructType(
    [
        T.StructField("gtid", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("status", T.ShortType()),
        T.StructField("seq", T.LongType()),
        T.StructField("batch", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("month", T.StringType()),
    ]
)

# What calls of a per-record handler gave, partitioned by (day, batch) of the record. `kind`
# and `error` are NULL where the call went well; `call_no` counts the calls
# of a record from 1.
OUTCOME_TABLE = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("context", T.StringType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("call_no", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("called", T.TimestampType()),
        T.StructField("day", T.StringType()),
        T.StructField("batch", T.StringType()),
    ]
)
OUTCOME_KEY = ["gtid", "context", "time", "part"]

AUDIT_EVENT = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)

# Delivered records, partitioned by (day, batch). A transaction with more events
# than one row may hold is stored as `n_parts` rows.
AUDIT_TABLE = T.StructType(
    [
        T.StructField("time", T.TimestampType()),
        T.StructField("context", T.StringType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("n_events", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("n_parts", T.IntegerType()),
        T.StructField("events", T.ArrayType(AUDIT_EVENT)),
        T.StructField("day", T.StringType()),
        T.StructField("batch", T.StringType()),
    ]
)
