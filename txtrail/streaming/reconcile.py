"""Reconcile: pending transactions of the lookback against the event table, again and again."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txtrail.operators.projections import to_stored_tx
from txtrail.operators.state import pending_notices
from txtrail.options import TrailOptions
from txtrail.plans.jobs import upkeep
from txtrail.schemas import STATUS_PROCESSED
from txtrail.sources.handlers import Handler, deliver
from txtrail.sources.tables import append_tx, read_tx_versions
from txtrail.streaming.online import IN_MEMORY, TX_KEY, candidate_events, correlate


def reconcile_once(
    spark: SparkSession,
    options: TrailOptions,
    batch_id: int,
    handler: Handler | None = None,
    as_of: dt.datetime | None = None,
) -> bool:
    """One pass; True when there was something pending.

    Matched notices get a new version with status 2, the others stay as they are
    and are looked at again until the lookback has passed.
    """
    as_of = as_of or dt.datetime.now(dt.timezone.utc)
    now = F.lit(as_of).cast("timestamp")
    # a name of its own: what a pass writes is never replaced by a replay, whose pending
    # transactions may be others; redeliveries are resolved on reading
    batch = f"reconcile-{batch_id}-{uuid.uuid4().hex[:12]}"
    versions = read_tx_versions(spark, options.store)
    # the files of `versions` are fixed by now: what is appended below is not seen
    pending = pending_notices(
        versions, now, options.lookback_hours, options.pending_limit
    ).persist(IN_MEMORY)
    if pending.isEmpty():
        pending.unpersist()
        return False
    events = candidate_events(spark, options, pending).persist(IN_MEMORY)
    written = correlate(spark, options, pending.select(*TX_KEY), events, batch, as_of)
    events.unpersist()
    pending.unpersist()
    if handler is not None:
        deliver(handler, written, batch_id, options, batch)
    done = to_stored_tx(
        written.select(*TX_KEY).distinct(), STATUS_PROCESSED, F.unix_micros(now)
    )
    append_tx(done, options.store, "reconcile", batch, options.time_zone, merge=True)
    return True


def start_reconcile(
    spark: SparkSession,
    options: TrailOptions,
    handler: Handler | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Runs `reconcile_once` on a clock."""

    def process(_: DataFrame, batch_id: int) -> None:
        reconcile_once(spark, options, batch_id, handler)

    return _on_a_clock(spark, options, "reconcile", process, trigger, options.recheck_interval)


def start_upkeep(
    spark: SparkSession, options: TrailOptions, trigger: dict | None = None
) -> StreamingQuery:
    """Runs `jobs.upkeep` on a clock, beside the other jobs."""

    def process(_: DataFrame, batch_id: int) -> None:
        upkeep(spark, options)

    return _on_a_clock(spark, options, "upkeep", process, trigger, options.upkeep_interval)


def _on_a_clock(
    spark: SparkSession,
    options: TrailOptions,
    name: str,
    process: Callable[[DataFrame, int], None],
    trigger: dict | None,
    interval: float,
) -> StreamingQuery:
    """The clock rows themselves are not used."""
    return (
        spark.readStream.format("rate")
        .option("rowsPerSecond", 1)
        .load()
        .writeStream.queryName(name)
        .foreachBatch(process)
        .option("checkpointLocation", f"{options.checkpoints}/{name}")
        .trigger(**(trigger or {"processingTime": f"{interval} seconds"}))
        .start()
    )
