import datetime as dt

import pytest
from pyspark.sql import functions as F

from txtrail.options import TopicOptions, TrailOptions
from txtrail.sources.topics import encode_events
from txtrail.streaming import lag

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
SCHEMA = "db string, `table` string, event_time timestamp, ingest_time timestamp"
ONCE = {"availableNow": True}


def minute(n, table, *lates):
    """Events that are ingested in minute n, so many seconds late (None: without a time)."""
    at = START + dt.timedelta(minutes=n, seconds=30)
    return [("d", table, None if s is None else at - dt.timedelta(seconds=s), at) for s in lates]


def feed(spark, tmp_path, steps, **options):
    """The alerts after each step; the query is stopped and started again in between."""
    (tmp_path / "in").mkdir()
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        store, checkpoints = str(tmp_path / "store"), str(tmp_path / "ck")
        lag.write_checks(lag.lag_checks(stream), store, checkpoints, ONCE).awaitTermination()
        alerts = lag.lag_alerts(lag.read_checks(spark, store), 60, **options)
        lag.write_alerts(alerts, store, checkpoints, ONCE).awaitTermination()
        rows = spark.read.schema(lag.ALERT).json(lag.alerts_path(store)).orderBy("table", "checked").collect()
        yield [(r.table, round((r.checked.timestamp() - START.timestamp()) / 60), r.alert, r.max_lag_seconds) for r in rows]


def test_alerts_over_restarts(spark, tmp_path):
    steps = [
        # beyond in minutes 0, 1 and 3 (nothing in 2 is no check); b has only two in a row
        minute(0, "a", 61, 5) + minute(1, "a", 100) + minute(0, "b", 90) + minute(1, "b", 90) + minute(2, "b", 60),
        minute(3, "a", 70) + minute(4, "a", 60, None),
        minute(5, "a", 500) + minute(6, "a", 1) + minute(7, "a", 2) + minute(8, "b", 1),
        minute(30, "c", 0),
    ]
    seen = list(feed(spark, tmp_path, steps, raise_after=3, clear_after=2))
    assert seen[-1] == [("a", 4, lag.RAISED, 70), ("a", 8, lag.CLEARED, 2)]
    assert all(set(before) <= set(after) for before, after in zip(seen, seen[1:]))


def test_no_time_is_no_lag(spark, tmp_path):
    steps = [minute(0, "a", None) + minute(1, "a", 61), minute(9, "a", 0)]
    assert list(feed(spark, tmp_path, steps, raise_after=1, clear_after=1))[-1] == [("a", 2, lag.RAISED, 61)]


def test_checks_of_a_table(spark):
    rows = minute(0, "a", 1, 5, 5) + minute(1, None, 7)
    found = lag.lag_checks(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.table, r.max_lag_seconds, r.n_events) for r in found} == {("a", 5, 3), (None, 7, 1)}
    assert lag.lag_checks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_watch_of_a_topic(spark, tmp_path):
    topic = TopicOptions("text", {"path": str(tmp_path / "binlog")})
    options = TrailOptions(
        str(tmp_path / "store"), str(tmp_path / "ck"), events_topic=topic,
        lag_alert_seconds=60, lag_window=1, lag_raise_after=1, lag_clear_after=1,
    )
    event = "db string, `table` string, action int, gtid string, time bigint, data string"
    for _ in range(2):
        # the second look closes the window of the first
        rows = spark.createDataFrame([("d", "t", 0, "s:1", 1_000_000_000, "{}")], event)
        encode_events(rows).coalesce(1).write.mode("append").text(topic.options["path"])
        lag.start_lag_checks(spark, options, ONCE).awaitTermination()
        lag.start_lag_alerts(spark, options, ONCE).awaitTermination()
    found = spark.read.json(lag.alerts_path(options.store)).select("db", "table", "alert").collect()
    assert [tuple(r) for r in found] == [("d", "t", lag.RAISED)]


def test_options(spark, tmp_path):
    with pytest.raises(ValueError):
        lag.start_lag_alerts(spark, TrailOptions(str(tmp_path), str(tmp_path)))
    with pytest.raises(ValueError):
        lag.lag_alerts(spark.range(1).select(F.lit("").alias("db")), 60, raise_after=0)
