"""Row changes to the events topic, and from the topic to the event table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txtrail.functions.gtid import gtid_valid
from txtrail.operators.filters import included_tables, row_events, valid_gtid
from txtrail.operators.projections import new_tx, raw_to_event, to_stored_event
from txtrail.options import TopicOptions, TrailOptions
from txtrail.session import query_id
from txtrail.sources.tables import append_events
from txtrail.sources.topics import (
    CORRUPT,
    decode_events,
    decode_raw,
    decode_tx,
    encode_events,
    encode_tx,
    good_rows,
    quarantine,
    read_topic,
)

# Why a transaction is not published.
UNDECODABLE, INVALID_GTID = "undecodable", "invalid gtid"


def topic_values(raw: DataFrame, tables: Sequence[str]) -> DataFrame:
    """Raw changes to topic messages: row changes of the included tables only.

    Works on a stream and on a table; nothing here shuffles.
    """
    return encode_events(raw_to_event(included_tables(row_events(raw), tables)))


def quarantine_path(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/quarantine_{name}"


def write_quarantine(decoded: DataFrame, store: str, name: str, batch: str) -> None:
    """Undecodable messages of one batch, if any; a replay replaces them."""
    bad = quarantine(decoded)
    if not bad.isEmpty():
        bad.write.mode("overwrite").text(f"{quarantine_path(store, name)}/batch={batch}")


def start_publish(
    spark: SparkSession,
    options: TrailOptions,
    source: TopicOptions,
    sink: TopicOptions,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Raw changes from `source` to the events topic: row changes of `options.tables` only.

    Undecodable messages do not get there; `start_raw_quarantine` keeps them.
    """
    raw = good_rows(decode_raw(read_topic(spark, source)))
    return _start(topic_values(raw, options.tables), "publish", sink, options, trigger)


def _start(
    values: DataFrame, name: str, sink: TopicOptions, options: TrailOptions, trigger: dict | None
) -> StreamingQuery:
    return (
        values.writeStream.queryName(name)
        .format(sink.format)
        .options(**sink.options)
        .option("checkpointLocation", f"{options.checkpoints}/{name}")
        .trigger(**(trigger or {"processingTime": f"{options.flush_interval} seconds"}))
        .start()
    )


def notices(decoded: DataFrame) -> DataFrame:
    """Notices as they go to the topic: without a time they are stamped with now."""
    told = F.when(F.col("time") > 0, F.timestamp_seconds("time")).otherwise(F.current_timestamp())
    return new_tx(decoded, F.col("context"), F.col("gtid"), told)


def start_publish_tx(
    spark: SparkSession,
    options: TrailOptions,
    source: TopicOptions,
    sink: TopicOptions,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Committed transactions (context, gtid and maybe time) to the transactions topic.

    Only those with a usable gtid get there; `start_tx_rejects` keeps the others.
    """
    sent = valid_gtid(notices(good_rows(decode_tx(read_topic(spark, source)))))
    return _start(encode_tx(sent), "publish_tx", sink, options, trigger)


def start_tx_rejects(
    spark: SparkSession, options: TrailOptions, source: TopicOptions, trigger: dict | None = None
) -> StreamingQuery:
    """What `start_publish_tx` leaves out, as (reason, value) in a folder of JSON lines."""
    decoded = decode_tx(read_topic(spark, source))
    broken = F.col(CORRUPT).isNotNull()
    out = decoded.where(broken | ~gtid_valid("gtid")).select(
        F.when(broken, F.lit(UNDECODABLE)).otherwise(F.lit(INVALID_GTID)).alias("reason"),
        F.when(broken, F.col(CORRUPT)).otherwise(F.to_json(F.struct("time", "context", "gtid"))).alias("value"),
    )
    sink = TopicOptions("json", {"path": quarantine_path(options.store, "unpublished_tx")})
    return _start(out, "tx_rejects", sink, options, trigger)


def start_raw_quarantine(
    spark: SparkSession,
    options: TrailOptions,
    source: TopicOptions,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Undecodable raw messages to a folder of their own, whole."""
    bad = quarantine(decode_raw(read_topic(spark, source)))
    return (
        bad.writeStream.queryName("raw_quarantine")
        .format("text")
        .option("path", quarantine_path(options.store, "raw"))
        .option("checkpointLocation", f"{options.checkpoints}/raw_quarantine")
        .trigger(**(trigger or {"processingTime": f"{options.flush_interval} seconds"}))
        .start()
    )


def start_ingest(
    spark: SparkSession, options: TrailOptions, trigger: dict | None = None
) -> StreamingQuery:
    """Topic to event table in micro-batches.

    The batch size is bounded by the topic's own rate option, e.g.
    `maxOffsetsPerTrigger`; the source holds back what is beyond it. A failing batch
    fails the query and is run again from the checkpoint: nothing is dropped.
    """
    decoded = decode_events(read_topic(spark, options.events_topic))
    # stamped here and not per write: a replayed micro-batch gets the same time
    stored = to_stored_event(decoded, keep=[CORRUPT])

    checkpoint = f"{options.checkpoints}/ingest"

    def write(batch: DataFrame, batch_id: int) -> None:
        name = f"ingest-{query_id(spark, checkpoint)}-{batch_id}"
        # bad messages are counted on the way and looked up again only if there are any
        counted = Observation()
        bad = F.count_if(F.col(CORRUPT).isNotNull()).alias("bad")
        rows = good_rows(batch.observe(counted, bad))
        append_events(rows, options.store, name, options.time_zone, merge=True)
        if counted.get["bad"]:
            write_quarantine(batch, options.store, "events", name)

    return (
        stored.writeStream.queryName("ingest")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{options.flush_interval} seconds"}))
        .start()
    )
