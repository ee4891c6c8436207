"""Row-wise reshaping between raw changes, envelopes, stored rows and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.functions.payload import action_code, payload_json
from txtrail.functions.timestamps import from_epoch
from txtrail.schemas import STATUS_PROCESSED


def raw_to_event(df: DataFrame) -> DataFrame:
    """Raw change (event_type, gtid_set, timestamp, before, after) to an event.

    `before` and `after` are maps of text, structs, or VARIANTs.
    """
    maps = isinstance(df.schema["before"].dataType, T.MapType)
    return df.select(
        "db",
        "table",
        action_code("event_type").alias("action"),
        F.col("gtid_set").alias("gtid"),
        F.col("timestamp").cast("bigint").alias("time"),
        payload_json(F.col("before"), F.col("after"), map_columns=maps).alias("data"),
    )


def to_stored_event(
    df: DataFrame, ingest_time: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Decoded envelope to stored event, and the columns in `keep` as they are.

    Event and ingest time are both kept. The default ingest time is the start of
    the batch, which a replayed micro-batch repeats.
    """
    return df.select(
        "db",
        "table",
        "action",
        "gtid",
        F.col("data").cast("string").alias("data"),
        from_epoch("time").alias("event_time"),
        (F.current_timestamp() if ingest_time is None else ingest_time).alias("ingest_time"),
        *keep,
    )


def to_stored_tx(df: DataFrame, status: int | Column, seq: Column | None = None) -> DataFrame:
    """Decoded notice to a status version; `seq` defaults to the batch start in microseconds."""
    status = F.lit(status) if isinstance(status, int) else status
    time = F.col("time")
    if isinstance(df.schema["time"].dataType, T.LongType):
        time = from_epoch(time)
    return df.select(
        "gtid",
        "context",
        time.alias("time"),
        status.cast("smallint").alias("status"),
        (F.unix_micros(F.current_timestamp()) if seq is None else seq.cast("bigint")).alias("seq"),
    )


def new_tx(df: DataFrame, context: Column, gtid: Column, as_of: Column | None = None) -> DataFrame:
    """Transaction notices for the rows of `df`, stamped with `as_of` or now (epoch seconds)."""
    now = F.current_timestamp() if as_of is None else as_of
    return df.select(
        F.unix_timestamp(now).alias("time"), context.alias("context"), gtid.alias("gtid")
    )


def mark_processed(df: DataFrame) -> DataFrame:
    return df.withColumn("status", F.lit(STATUS_PROCESSED).cast("smallint"))


def event_struct() -> Column:
    """An event inside a record; field order is the sort order of a record's events."""
    return F.struct("db", "table", "action", "gtid", "data")
