"""Row filters. All are plain predicates that Catalyst can push to the scan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txtrail.functions.gtid import LENIENT, gtid_valid
from txtrail.functions.predicates import in_args
from txtrail.operators.joins import MAX_BROADCAST_ROWS
from txtrail.schemas import ACTION_CODES, EVENT_FIELDS, STATUS_UNPROCESSED

# More (db, table) pairs than this become a join instead of a predicate.
MAX_INLINE_TABLES = 500


def row_events(df: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Keeps row changes; drops schema changes, heartbeats and the like."""
    return df.where(F.col(event_type).isin(list(ACTION_CODES)))


def parse_tables(entries: Sequence[str]) -> dict[str, set[str]]:
    """`db.table` entries as {db: {table}}; parts after the second are ignored."""
    tables: dict[str, set[str]] = defaultdict(set)
    for entry in entries:
        parts = entry.split(".")
        if len(parts) < 2:
            raise ValueError(f"expected 'db.table', got {entry!r}")
        tables[parts[0]].add(parts[1])
    return dict(tables)


def included_tables(df: DataFrame, entries: Sequence[str]) -> DataFrame:
    """Keeps changes of the listed tables; exact, case-sensitive match; no entries keep nothing."""
    tables = parse_tables(entries)
    if sum(len(names) for names in tables.values()) <= MAX_INLINE_TABLES:
        return df.where(_table_predicate(tables))
    pairs = [(db, name) for db, names in tables.items() for name in sorted(names)]
    include = df.sparkSession.createDataFrame(pairs, "db string, `table` string")
    if len(pairs) <= MAX_BROADCAST_ROWS:
        include = F.broadcast(include)
    return df.join(include, ["db", "table"], "left_semi")


def _table_predicate(tables: dict[str, set[str]]) -> Column:
    keep = F.lit(False)
    for db, names in sorted(tables.items()):
        keep = keep | ((F.col("db") == db) & F.col("table").isin(sorted(names)))
    return keep


def valid_gtid(df: DataFrame, gtid: str = "gtid", mode: str = LENIENT) -> DataFrame:
    """Keeps rows with a well-formed id; the id itself is carried untrimmed."""
    return df.where(gtid_valid(gtid, mode))


def invalid_gtid(df: DataFrame, gtid: str = "gtid", mode: str = LENIENT) -> DataFrame:
    """The rows `valid_gtid` drops: transactions without a usable id."""
    return df.where(~gtid_valid(gtid, mode))


def in_lookback(time: Column | str, as_of: Column, hours: int) -> Column:
    """time >= as_of - hours; no upper bound."""
    return (F.col(time) if isinstance(time, str) else time) >= as_of - F.expr(
        f"INTERVAL {int(hours)} HOURS"
    )


def unprocessed(df: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    """Pending transactions not older than the lookback."""
    return df.where((F.col("status") == STATUS_UNPROCESSED) & in_lookback("time", as_of, hours))


def events_of(events: DataFrame, gtid: str) -> DataFrame:
    """Events of one transaction; the equality reaches the Parquet scan."""
    return events.where(F.col("gtid") == gtid).select(*EVENT_FIELDS)


def events_of_any(events: DataFrame, *gtids: object) -> DataFrame:
    """Events of the transactions given as scalars and lists."""
    return events.where(in_args("gtid", *gtids)).select(*EVENT_FIELDS)
