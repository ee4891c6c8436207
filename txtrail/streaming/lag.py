"""Lag watch on the stream: how late events arrive, and alerts that do not flicker.

Events are reduced to one check per table and window of ingest time, and the checks are
stored. A second query follows them: an alert is raised after some checks in a row beyond
the threshold and cleared after some in a row within it; the state of a table is one flag
and one counter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txtrail.operators.projections import to_stored_event
from txtrail.options import TrailOptions
from txtrail.sources.topics import decode_events, good_rows, read_topic

RAISED, CLEARED = "raised", "cleared"

CHECK = "db string, `table` string, checked timestamp, max_lag_seconds bigint, n_events bigint"
ALERT = "db string, `table` string, checked timestamp, alert string, max_lag_seconds bigint"
STATE = "raised boolean, streak int"


def lag_checks(events: DataFrame, window: str = "1 minute", slide: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """(db, table, checked, max_lag_seconds, n_events), `checked` being the end of the window.

    `events` has event_time and ingest_time. A stream gives a window once, when the watermark
    on ingest_time has passed it; a window without events is no check. Only one row per table,
    window and task is shuffled, so a hot table does not matter.
    """
    lag = F.timestamp_diff("SECOND", F.col("event_time"), F.col("ingest_time"))
    windows = F.window("ingest_time", window, slide) if slide else F.window("ingest_time", window)
    found = (
        events.withWatermark("ingest_time", delay)
        .groupBy("db", "table", windows.alias("window"))
        .agg(F.max(lag).alias("max_lag_seconds"), F.count("*").alias("n_events"))
    )
    return found.select("db", "table", F.col("window.end").alias("checked"), "max_lag_seconds", "n_events")


def lag_alerts(checks: DataFrame, threshold_seconds: int, raise_after: int = 3, clear_after: int = 3) -> DataFrame:
    """(db, table, checked, alert, max_lag_seconds): each time an alert is raised or cleared.

    Checks of a table count in order of `checked`. Exactly at the threshold is within it; a
    null lag (an event without a time) is, too. Nothing is cleared that was not raised.
    """
    if raise_after < 1 or clear_after < 1:
        raise ValueError("an alert changes after one check at least")
    return checks.groupBy("db", "table").applyInPandasWithState(
        _judge(threshold_seconds, raise_after, clear_after), ALERT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def _judge(
    threshold: int, raise_after: int, clear_after: int
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raised, streak = state.get if state.exists else (False, 0)
        # as many rows as windows have closed since the last batch
        checks = pd.concat([c[["checked", "max_lag_seconds"]] for c in chunks]).sort_values("checked", kind="stable")
        changes = []
        for checked, lag in zip(checks["checked"], checks["max_lag_seconds"]):
            beyond = bool(lag > threshold)
            streak = streak + 1 if beyond != raised else 0
            if streak >= (clear_after if raised else raise_after):
                raised, streak = beyond, 0
                changes.append((*key, checked, RAISED if raised else CLEARED, int(lag) if lag == lag else None))
        state.update((raised, streak))
        if changes:
            yield pd.DataFrame(changes, columns=["db", "table", "checked", "alert", "max_lag_seconds"])

    return judge


def checks_path(store: str) -> str:
    return f"{store.rstrip('/')}/lag_checks"


def alerts_path(store: str) -> str:
    return f"{store.rstrip('/')}/lag_alerts"


def write_checks(checks: DataFrame, store: str, checkpoints: str, trigger: dict) -> StreamingQuery:
    return _written(checks, "lag_checks", "parquet", checks_path(store), checkpoints, trigger)


def read_checks(spark: SparkSession, store: str) -> DataFrame:
    """The stored checks as a stream: batch by batch as they were written, later windows later."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checks_path(store))
    # a stream cannot start on a folder that is not there yet
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.readStream.schema(CHECK).parquet(checks_path(store))


def write_alerts(alerts: DataFrame, store: str, checkpoints: str, trigger: dict) -> StreamingQuery:
    return _written(alerts, "lag_alerts", "json", alerts_path(store), checkpoints, trigger)


def _written(
    rows: DataFrame, name: str, format: str, path: str, checkpoints: str, trigger: dict
) -> StreamingQuery:
    return (
        rows.writeStream.queryName(name)
        .format(format)
        .option("path", path)
        .option("checkpointLocation", f"{checkpoints}/{name}")
        .trigger(**trigger)
        .start()
    )


def start_lag_checks(spark: SparkSession, options: TrailOptions, trigger: dict | None = None) -> StreamingQuery:
    """Checks of the events topic. An event counts as ingested when this job reads it."""
    events = to_stored_event(good_rows(decode_events(read_topic(spark, options.events_topic))))
    checks = lag_checks(events, f"{options.lag_window} seconds")
    return write_checks(checks, options.store, options.checkpoints, trigger or _every(options))


def start_lag_alerts(spark: SparkSession, options: TrailOptions, trigger: dict | None = None) -> StreamingQuery:
    """Alerts as they change, as JSON lines."""
    if options.lag_alert_seconds is None:
        raise ValueError("set lag_alert_seconds")
    checks = read_checks(spark, options.store)
    alerts = lag_alerts(checks, options.lag_alert_seconds, options.lag_raise_after, options.lag_clear_after)
    return write_alerts(alerts, options.store, options.checkpoints, trigger or _every(options))


def _every(options: TrailOptions) -> dict:
    return {"processingTime": f"{options.flush_interval} seconds"}
