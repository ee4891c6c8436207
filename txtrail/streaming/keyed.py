"""Online correlation as keyed state with timers: no look is repeated, nothing waits.

For each gtid the state holds how many events have arrived, when the last one did, and the
notices that are still open: a few numbers, never the events. The gtids of one hash bucket
share a row of state and a Python call, as a call costs far more than the work for a gtid;
each is judged by itself. A notice gets its record as
soon as its events are complete, is reported pending when its grace has passed, stays open
for late events, and expires with the lookback. Time is the arrival of messages, carried
as a watermark, so timers also fire for keys nothing arrives for any more.

Records themselves are read from the event table, once for each transaction that is
complete; one whose events are not all stored yet is left to the reconcile job.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txtrail.operators.projections import to_stored_tx
from txtrail.options import ANY, EXPECTED_COUNT, TrailOptions
from txtrail.schemas import STATUS_PROCESSED, STATUS_UNPROCESSED
from txtrail.session import query_id
from txtrail.sources.handlers import Handler, deliver
from txtrail.sources.tables import append_tx
from txtrail.sources.topics import decode_events, decode_tx, good_rows, read_topic
from txtrail.streaming.online import IN_MEMORY, TX_KEY, candidate_events, correlate

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORD, PENDING, EXPIRED = "record", "pending", "expired"

OUTCOME = "gtid string, context string, time timestamp, outcome string, n_events bigint"
# of a bucket: its gtids with their events, and its open notices, each with the place of its
# gtid, its time and arrival, and whether it was reported pending
STATE = (
    "gtids array<string>, n_events array<bigint>, lasts array<bigint>,"
    " owners array<int>, contexts array<string>, times array<bigint>, since array<bigint>, told array<boolean>"
)
# Part of the state's key: another number needs a new checkpoint.
BUCKETS = 1024
MESSAGE_FIELDS = ["gtid", "context", "time", "arrived"]

_MILLIS = 1000


def messages(tx: DataFrame, events: DataFrame) -> DataFrame:
    """Both streams as one: (gtid, context, time, arrived); events have neither context nor time.

    Only the id of an event goes on, whatever its payload.
    """
    notices = tx.select("gtid", F.coalesce("context", F.lit("")).alias("context"), "time", "arrived")
    changes = events.select("gtid", F.lit(None).cast("string").alias("context"), F.lit(None).cast("timestamp").alias("time"), "arrived")
    return notices.unionByName(changes)


def outcomes(
    stream: DataFrame,
    completeness: str = ANY,
    expected_counts: Mapping[int, int] | None = None,
    grace_seconds: float = 3.0,
    quiet_seconds: float = 3.0,
    lookback_hours: float = 72,
    event_hours: float = 72,
    delay: str = "0 seconds",
) -> DataFrame:
    """(gtid, context, time, outcome, n_events) as they are decided; `stream` as `messages` makes it.

    A notice that is delivered again while it is open counts once. Counts of events no notice
    came for are forgotten after `event_hours`. Arrival must not go back by more than `delay`:
    later messages are dropped by the watermark, so stamp them on reading. A null gtid is a
    key like any other.
    """
    judge = _judge_bucket(
        completeness,
        {str(k): v for k, v in (expected_counts or {}).items()},
        int(grace_seconds * _MILLIS),
        int(quiet_seconds * _MILLIS),
        int(lookback_hours * 3600 * _MILLIS),
        int(event_hours * 3600 * _MILLIS),
    )
    return (
        stream.select(*MESSAGE_FIELDS)
        .withColumn("bucket", F.pmod(F.xxhash64("gtid"), F.lit(BUCKETS)).cast("int"))
        .withWatermark("arrived", delay)
        .groupBy("bucket")
        .applyInPandasWithState(judge, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def _decide(
    completeness: str, expected: dict[str, int], grace: int, quiet: int, lookback: int, keep: int
) -> Callable[[int, int, list[tuple], int], tuple[list[tuple], list[tuple], int | None]]:
    """What is found for one gtid, the notices left open, and when to look again (None: never)."""

    def complete(context: str, n_events: int, last: int, now: int) -> bool:
        if completeness == ANY:
            return n_events > 0
        if completeness == EXPECTED_COUNT:
            return n_events >= expected.get(context.split(".", 1)[0], 1)
        return n_events > 0 and last + quiet <= now

    def decide(n_events: int, last: int, open_: list[tuple], now: int) -> tuple[list[tuple], list[tuple], int | None]:
        found, left, timers = [], [], []
        for context, time, since, told in open_:
            if complete(context, n_events, last, now):
                found.append((context, time, RECORD))
                continue
            if not told and since + grace <= now:
                found.append((context, time, PENDING))
                told = True
            if since + lookback <= now:
                found.append((context, time, EXPIRED))
                continue
            left.append((context, time, since, told))
            timers.append(since + (lookback if told else min(grace, lookback)))
            if n_events and completeness not in (ANY, EXPECTED_COUNT):
                timers.append(last + quiet)
        if not left and (not n_events or last + keep <= now):
            return found, left, None
        # without a notice, the count goes when its time has come
        return found, left, max(now + 1, min(timers or [last + keep]))

    return decide


def _messages_of(chunk: pd.DataFrame) -> Iterator[tuple[str | None, int, int]]:
    """(context, time, arrived) of each message, in microseconds and milliseconds."""
    arrived = chunk["arrived"].to_numpy().astype("datetime64[ms]").astype("int64").tolist()
    times = chunk["time"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
    return zip(chunk["context"].tolist(), times, arrived)


def _outcome_rows(found: list[tuple]) -> pd.DataFrame:
    gtids, contexts, times, kinds, counts = zip(*found)
    return pd.DataFrame(
        {
            "gtid": gtids,
            "context": contexts,
            "time": np.array(times, "datetime64[us]"),
            "outcome": kinds,
            "n_events": counts,
        }
    )


def _judge(
    completeness: str, expected: dict[str, int], grace: int, quiet: int, lookback: int, keep: int
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Judge of a single gtid, the key of its chunks."""
    judge_bucket = _judge_bucket(completeness, expected, grace, quiet, lookback, keep)

    def judge(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return judge_bucket((0,), (chunk.assign(gtid=key[0]) for chunk in chunks), state)

    return judge


def _judge_bucket(
    completeness: str, expected: dict[str, int], grace: int, quiet: int, lookback: int, keep: int
) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    decide = _decide(completeness, expected, grace, quiet, lookback, keep)

    def judge(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # gtid -> [events, arrival of the last, open notices]
        known: dict[str | None, list] = {}
        if state.exists:
            gtids, counts, lasts, owners, *notices = (list(column) for column in state.get)
            for gtid, n_events, last in zip(gtids, counts, lasts):
                known[gtid] = [n_events, last, []]
            for owner, *notice in zip(owners, *notices):
                known[gtids[owner]][2].append(tuple(notice))
        for chunk in chunks:
            for gtid, (context, time, since) in zip(chunk["gtid"].tolist(), _messages_of(chunk)):
                entry = known.setdefault(gtid, [0, 0, []])
                if context is None:
                    entry[0], entry[1] = entry[0] + 1, max(entry[1], since)
                elif all((context, time) != (o[0], o[1]) for o in entry[2]):
                    entry[2].append((context, time, since, False))
        now = state.getCurrentWatermarkMs()
        found, kept, open_, timers = [], [], [], []
        for gtid, (n_events, last, notices) in known.items():
            decided, left, timer = decide(n_events, last, notices, now)
            found += [(gtid, *outcome, n_events) for outcome in decided]
            if timer is not None:
                open_ += [(len(kept), *notice) for notice in left]
                kept.append((gtid, n_events, last))
                timers.append(timer)
        if kept:
            notices = [list(c) for c in zip(*open_)] or [[], [], [], [], []]
            state.update((*(list(c) for c in zip(*kept)), *notices))
            state.setTimeoutTimestamp(min(timers))
        else:
            state.remove()
        if found:
            yield _outcome_rows(found)

    return judge


def process_outcomes(
    spark: SparkSession,
    options: TrailOptions,
    decided: DataFrame,
    batch_id: int,
    handler: Handler | None,
    query: str = "",
    as_of: dt.datetime | None = None,
) -> None:
    """Records of the transactions decided in this batch, then statuses: 2 with a record, else 1.

    A replay of the batch replaces what it wrote. A record that has fewer events stored than
    the state has counted is not written: its notice stays at status 1 for the reconcile job.
    """
    now = F.unix_micros(F.lit(as_of or dt.datetime.now(dt.timezone.utc)).cast("timestamp"))
    batch = f"keyed-{query}-{batch_id}"
    due = decided.where(F.col("outcome") == RECORD)
    events = candidate_events(spark, options, due).persist(IN_MEMORY)
    stored = events.groupBy("gtid").agg(F.count("*").alias("n_stored"))
    ready = due.join(stored, "gtid").where("n_stored >= n_events").select(*TX_KEY)
    written = correlate(spark, options, ready, events, batch, as_of or dt.datetime.now(dt.timezone.utc), judged=True)
    events.unpersist()
    if handler is not None:
        deliver(handler, written, batch_id, options, batch)
    done = written.select(*TX_KEY).distinct().withColumn("_done", F.lit(True))
    # an expired notice was reported pending before
    told = decided.where(F.col("outcome") != EXPIRED).select(*TX_KEY).distinct()
    status = F.when(F.col("_done"), STATUS_PROCESSED).otherwise(STATUS_UNPROCESSED)
    versions = to_stored_tx(told.join(done, TX_KEY, "left"), status, now)
    append_tx(versions, options.store, "keyed", batch, options.time_zone, merge=True)


def start_online_state(
    spark: SparkSession,
    options: TrailOptions,
    handler: Handler | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """The online job over keyed state, beside `start_ingest`, which stores the events."""
    stamped = F.current_timestamp()
    tx = good_rows(decode_tx(read_topic(spark, options.tx_topic)))
    events = good_rows(decode_events(read_topic(spark, options.events_topic)))
    both = messages(
        tx.withColumn("time", F.timestamp_seconds("time")).withColumn("arrived", stamped),
        events.withColumn("arrived", stamped),
    )
    decided = outcomes(
        both,
        options.completeness,
        options.expected_counts,
        options.polls * options.poll_interval,
        options.quiet_seconds,
        options.lookback_hours,
        options.event_days * 24,
    )
    checkpoint = f"{options.checkpoints}/online_state"

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if not batch.isEmpty():
                process_outcomes(spark, options, batch, batch_id, handler, query_id(spark, checkpoint))
        finally:
            batch.unpersist()

    return (
        decided.writeStream.queryName("online_state")
        .foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{options.flush_interval} seconds"}))
        .start()
    )
