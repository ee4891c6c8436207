"""Correlation and quiescence inside stream state, without the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlate_streams(
    tx: DataFrame, events: DataFrame, grace: str = "3 seconds", lateness: str = "10 seconds"
) -> DataFrame:
    """Left outer join of two streams on gtid within `grace` around the transaction time.

    `tx` has (gtid, context, time), `events` (gtid, db, table, action, data,
    event_time), times as TIMESTAMP. A transaction without events comes out with NULL
    event columns once both watermarks are past its grace. State holds only rows
    inside grace and lateness.
    """
    left = tx.withWatermark("time", lateness).alias("t")
    right = events.withWatermark("event_time", lateness).alias("e")
    band = F.expr(
        "t.gtid = e.gtid"
        f" AND e.event_time >= t.time - INTERVAL {grace}"
        f" AND e.event_time <= t.time + INTERVAL {grace}"
    )
    return left.join(right, band, "left_outer").select(
        "t.gtid", "t.context", "t.time", "e.db", "e.table", "e.action", "e.data", "e.event_time"
    )


def quiescent_groups(
    events: DataFrame, quiet: str = "3 seconds", lateness: str = "10 seconds"
) -> DataFrame:
    """(gtid, first_time, last_time, n_events) of event groups followed by a quiet period.

    Also for batch input, where the watermark has no effect. Events are counted, not
    collected: the state of a very large transaction stays one row.
    """
    session = F.session_window("event_time", quiet)
    return (
        events.withWatermark("event_time", lateness)
        .groupBy(session.alias("session"), "gtid")
        .agg(
            F.min("event_time").alias("first_time"),
            F.max("event_time").alias("last_time"),
            F.count("*").alias("n_events"),
        )
        .drop("session")
    )
