"""Joins on the transaction id, and the size check in front of every broadcast."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txtrail.functions.gtid import gtid_uuid
from txtrail.operators.skew import join_unique

# A side with at most this many short rows is broadcast, a larger one is shuffled.
MAX_BROADCAST_ROWS = 200_000
# Ids of more servers than this are not turned into range predicates.
MAX_RANGES = 50


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Counts at most max_rows + 1 rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def matched_long(tx: DataFrame, events: DataFrame) -> DataFrame:
    """One row per (transaction, event): the form that needs no per-key collection.

    Both sides come straight from their shuffle, so adaptive execution can split the
    partition of a hot gtid.
    """
    return tx.select("time", "context", "gtid").join(
        events.select("gtid", "db", "table", "action", "data"), "gtid", "inner"
    )


def gtids(df: DataFrame) -> DataFrame:
    """Distinct ids; a hot id is reduced to one row per task before it is shuffled."""
    return df.select("gtid").distinct()


def unmatched_tx(tx: DataFrame, events: DataFrame, hot: list[str] | None = None) -> DataFrame:
    """Transactions none of whose events is known yet."""
    return join_unique(tx, gtids(events), "left_anti", hot=hot)


def orphan_events(events: DataFrame, tx: DataFrame) -> DataFrame:
    """Events of no known transaction, e.g. direct edits of the database."""
    return join_unique(events, gtids(tx), "left_anti")


def restrict_to(events: DataFrame, keys: DataFrame, small: bool | None = None) -> DataFrame:
    """Events whose gtid is among `keys`.

    Few keys are broadcast, so the event table is filtered where it is read, and the
    range of ids per server lets the scan skip files and row groups sorted by gtid.
    """
    keys = gtids(keys)
    small = is_small(keys) if small is None else small
    if not small:
        return join_unique(events, keys, "left_semi")
    in_range = id_ranges(keys)
    if in_range is not None:
        events = events.where(in_range)
    return events.join(F.broadcast(keys), "gtid", "left_semi")


def id_ranges(keys: DataFrame) -> Column | None:
    """Predicate `lowest id <= gtid <= highest id` per server; None for too many servers."""
    bounds = (
        keys.groupBy(gtid_uuid("gtid").alias("server"))
        .agg(F.min("gtid").alias("low"), F.max("gtid").alias("high"))
        .limit(MAX_RANGES + 1)
        .collect()
    )
    if not bounds:
        return F.lit(False)
    if len(bounds) > MAX_RANGES:
        return None
    return reduce(or_, [F.col("gtid").between(b.low, b.high) for b in bounds])
