"""Registered queries: every operator over the whole provided tables.

Each function takes (spark, sf_dir) and returns flat columns. `oracle.py` holds the
check SQL under the same name.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.functions import context as ctx
from txtrail.functions import gtid as gt
from txtrail.functions import ids
from txtrail.functions import payload as pl
from txtrail.functions import timestamps as tm
from txtrail.functions.predicates import in_args
from txtrail.operators import aggregates, completeness, filters, gtid_sets, joins, projections, records
from txtrail.operators import snapshots, state
from txtrail.options import EXPECTED_COUNT, QUIESCENT, TopicOptions, TrailOptions
from txtrail.plans import fixtures as fx
from txtrail.plans import reports
from txtrail.plans.jobs import backfill, close_days_before, redeliver, upkeep
from txtrail.session import new_folder
from txtrail.sources import bulk_text, handlers, tables, topics
from txtrail.streaming import ingest, keyed, lag, online, reconcile
from txtrail.streaming import joins as stream_joins

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

UTC = dt.timezone.utc
TABLES = ["tpch.line_open"]
ALL_TABLES = ["tpch.line_open", "tpch.line_fill"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- correlation -----------------------------------------------------------------


def record_facts(records_: DataFrame) -> DataFrame:
    """Records as flat columns; the digest covers every event in its order."""
    events = F.col("events")

    def n(action: int) -> Column:
        return F.size(F.filter(events, lambda e: e["action"] == action)).cast("bigint")

    def line(e: Column) -> Column:
        return F.concat_ws("|", e["db"], e["table"], e["action"].cast("string"), e["data"])

    return records_.select(
        "gtid",
        ctx.context_type("context").alias("context_type"),
        "n_events",
        n(0).alias("n_insert"),
        n(1).alias("n_update"),
        n(2).alias("n_delete"),
        F.md5(F.array_join(F.transform(events, line), ";")).alias("digest"),
    )


@query
def audit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, events = fx.tx_info(spark, sf_dir), fx.binlog_event(spark, sf_dir)
    return record_facts(records.audit_records(tx, events))


@query
def audit_records_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records with few events per row; the sums over the parts of each."""
    tx, events = fx.tx_info(spark, sf_dir), fx.binlog_event(spark, sf_dir)
    parts = records.audit_records(tx, events, max_events=3)

    def n(action: int) -> Column:
        of_action = F.filter("events", lambda e: e["action"] == action)
        return F.sum(F.size(of_action))

    return parts.groupBy("gtid", "context", "n_events").agg(
        F.sum(F.size("events")).alias("n_collected"),
        n(0).alias("n_insert"),
        n(1).alias("n_update"),
        n(2).alias("n_delete"),
    )


@query
def audit_events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, events = fx.tx_info(spark, sf_dir), fx.binlog_event(spark, sf_dir)
    long = joins.matched_long(tx, events)
    return long.select(
        "gtid",
        "context",
        "db",
        "table",
        pl.action_name("action").alias("action_name"),
        pl.payload_field("data", "before", "part").alias("before_part"),
        pl.payload_field("data", "after", "line").alias("after_line"),
    )


@query
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, events = fx.tx_info(spark, sf_dir), fx.binlog_event(spark, sf_dir)
    return records.audit_summary(tx, events).select(
        "gtid", "context", "n_events", "n_insert", "n_update", "n_delete"
    )


@query
def pending_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, events = fx.tx_info(spark, sf_dir), fx.binlog_event(spark, sf_dir)
    pending = joins.unmatched_tx(tx, events)
    stored = projections.to_stored_tx(pending, 1, F.lit(0))
    return stored.select("gtid", "context", stored.status.cast("int").alias("status"))


@query
def orphan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = fx.tx_info(spark, sf_dir).where(ctx.context_type("context") != 1)
    return joins.orphan_events(fx.binlog_event(spark, sf_dir), tx).select("gtid", "table", "data")


@query
def events_of_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-list restriction: events of all transactions of context type 1."""
    tx = fx.tx_info(spark, sf_dir).where(ctx.context_type("context") == 1)
    events = joins.restrict_to(fx.binlog_event(spark, sf_dir), tx)
    return events.select("gtid", "table", "action", "data")


# --- filters and lookups -----------------------------------------------------------


@query
def row_event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.row_events(fx.raw_changes(spark, sf_dir))
    return kept.select(F.col("gtid_set").alias("gtid"), "table", "event_type")


@query
def included_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.included_tables(fx.binlog_event(spark, sf_dir), TABLES)
    return kept.select("gtid", "db", "table", "action", "data")


@query
def event_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.events_of(fx.binlog_event(spark, sf_dir), f"{fx.SERVER}:7")


@query
def event_multi_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [f"{fx.SERVER}:{n}" for n in (1, 2, 3, 5, 8, 13)]
    events = fx.binlog_event(spark, sf_dir)
    return filters.events_of_any(events, keys[0], keys[1:])


@query
def predicate_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fx.table(spark, sf_dir, "customer")
    keep = in_args("c_mktsegment", "BUILDING", ["MACHINERY"]) & in_args("c_nationkey", 1, [2, 3])
    return customers.where(keep | in_args("c_custkey")).select("c_custkey", "c_name")


@query
def valid_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.valid_gtid(fx.gtid_samples(spark, sf_dir)).select("id", "gtid")


@query
def rejected_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.invalid_gtid(fx.gtid_samples(spark, sf_dir)).select("id", "gtid")


# --- scalar functions --------------------------------------------------------------


@query
def gtid_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.gtid_samples(spark, sf_dir).select(
        "id",
        gt.gtid_valid("gtid").alias("valid"),
        gt.gtid_valid("gtid", gt.STRICT).alias("valid_strict"),
    )


@query
def gtid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.gtid_samples(spark, sf_dir).select(
        "id",
        gt.gtid_uuid("gtid").alias("server"),
        F.size(gt.gtid_intervals("gtid")).alias("n_intervals"),
        gt.gtid_tx_count("gtid").alias("n_tx"),
    )


@query
def gtid_executed_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals that all ids of the table cover, by server."""
    return gtid_sets.executed_set(fx.gtid_runs(spark, sf_dir))


@query
def gtid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions between the first and the last of a server that no id covers."""
    return gtid_sets.missing_ranges(fx.gtid_runs(spark, sf_dir))


@query
def context_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = ctx.parse_context("context").alias("p")
    return fx.context_samples(spark, sf_dir).select("id", parsed).select("id", "p.*")


@query
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 3
    text = ctx.format_context(
        kind,
        F.when(kind > 0, F.col("o_orderstatus")),
        F.when(kind > 1, F.col("o_custkey").cast("string")),
    )
    return orders.select("o_orderkey", text.alias("context"))


@query
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_params = (F.col("o_orderkey") % 4).cast("int")
    params = F.slice(
        F.array("o_orderstatus", F.col("o_custkey").cast("string"), "o_orderpriority"),
        F.lit(1),
        n_params,
    )
    built = ctx.build_context(F.col("o_orderkey") % 7, params).alias("c")
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", built)
    return orders.select("o_orderkey", "c.*")


@query
def payload_after_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pl.with_fields(fx.binlog_event(spark, sf_dir), "after", ["part"])
    return rows.select("gtid", "action", "after_part").where(F.col("after_part").isNotNull())


@query
def payload_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [
        pl.SourceColumn("part", "BIGINT", nullable=False),
        pl.SourceColumn("line", "INT", unsigned=True),
    ]
    return pl.with_typed(fx.binlog_event(spark, sf_dir), columns).select(
        "gtid",
        F.col("before.line").alias("before_line"),
        F.col("after.part").alias("after_part"),
        F.col("after.line").alias("after_line"),
    )


@query
def datetime_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and times of all orders in every accepted text length, and in bad ones."""
    kind, day = F.col("o_orderkey") % 8, F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(kind == 0, day)
        .when(kind == 1, F.concat(day, F.lit(" 19:41:23")))
        .when(kind == 2, F.concat(day, F.lit(" 19:41:23.5")))
        .when(kind == 3, F.concat(day, F.lit(" 19:41:23.123456")))
        .when(kind == 4, F.lit("0000-00-00 00:00:00"))
        .when(kind == 5, F.concat(day, F.lit(" 19:41:23.")))
        .when(kind == 6, F.concat(F.substring(day, 1, 5), F.lit("13-01")))
    )
    parsed = tm.nullable_time(F.col("text"))
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", parsed.alias("p")).select(
        "o_orderkey",
        F.date_format("p.time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"),
        "p.valid",
        "p.error",
    )


@query
def duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations beyond a day and below zero, from the line items."""
    hours = F.col("l_partkey") % 900
    sign = F.when(F.col("l_returnflag") == "R", "-").otherwise("")
    rest = F.format_string(":%02d:%02d.%d", "l_linenumber", F.col("l_suppkey") % 70, "l_linenumber")
    text = F.concat(sign, F.lpad(hours.cast("string"), 3, "0"), rest)
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", tm.parse_duration(text).alias("micros")
    )


@query
def uuid_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", fx.order_uuid().alias("uuid"))
    coded = orders.withColumn("code", ids.encode_uuid("uuid"))
    return coded.select(
        "o_orderkey", "code", ids.short_id(F.col("code")).alias("short"),
        ids.decode_uuid("code").alias("uuid"),
        ids.decode_uuid(F.concat(F.lit("0"), F.substring("code", 2, 21))).isNull()
        .alias("bad_rejected"),
    )


@query
def short_id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With three characters instead of eight, so that there are collisions to report."""
    coded = fx.table(spark, sf_dir, "orders").select(ids.encode_uuid(fx.order_uuid()).alias("code"))
    return aggregates.short_id_collisions(coded, "code", length=3)


@query
def new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One random id per order; only facts that hold for every such id are returned."""
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", ids.new_uuid().alias("uuid"))
    coded = orders.withColumn("code", ids.encode_uuid("uuid"))
    shape = r"\A[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[4-7][0-9a-f]{3}-[0-9a-f]{12}\z"
    return coded.select(
        "o_orderkey",
        F.col("uuid").rlike(shape).alias("well_formed"),
        (F.length(ids.short_id(F.col("code"))) == 8).alias("short_ok"),
    )


# --- topics --------------------------------------------------------------------------


@query
def normalise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = filters.row_events(fx.raw_changes(spark, sf_dir))
    return projections.raw_to_event(raw)


@query
def topic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw changes to topic messages of the included tables."""
    return ingest.topic_values(fx.raw_changes(spark, sf_dir), TABLES)


@query
def topic_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2024-01-01 00:00:00 UTC").cast("timestamp")
    orders = fx.table(spark, sf_dir, "orders")
    notices = projections.new_tx(orders, fx.order_context(), fx.gtid_of("o_orderkey"), as_of)
    return topics.encode_tx(notices)


@query
def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = topics.encode_events(fx.envelopes(spark, sf_dir))
    decoded = topics.good_rows(topics.decode_events(messages))
    stored = projections.to_stored_event(decoded, F.lit(0).cast("timestamp"))
    return stored.select(
        "db", "table", "action", "gtid", "data",
        F.unix_timestamp("event_time").alias("event_seconds"),
    )


@query
def decoded_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = topics.decode_tx(topics.encode_tx(fx.notices(spark, sf_dir)))
    stored = projections.to_stored_tx(topics.good_rows(decoded), 1, F.lit(0))
    return stored.select(
        "gtid", "context", F.unix_timestamp("time").alias("seconds"),
        F.col("status").cast("int").alias("status"),
    )


@query
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all line items, some of them broken in four ways; the broken ones."""
    kind, key = F.col("l_orderkey") % 10, F.col("l_orderkey").cast("string")
    head = F.concat(F.lit('{"db":"tpch","gtid":"'), key, F.lit('","action":'))
    message = (
        F.when(kind == 0, F.concat(head, F.lit("1")))
        .when(kind == 1, F.concat(head, F.lit('1,"data":"***"}')))
        .when(kind == 2, F.concat(head, F.lit('"insert"}')))
        .when(kind == 3, F.concat(F.lit("["), head, F.lit("1}]")))
        .when(kind == 4, F.concat(head, F.lit('null,"other":{"x":[1]}}')))
        .otherwise(F.concat(head, F.lit('1,"data":"e30="}')))
    )
    messages = fx.table(spark, sf_dir, "lineitem").select(message.alias("value"))
    return topics.quarantine(topics.decode_events(messages))


# --- state -------------------------------------------------------------------------


def status_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction as version 1; those with events again as processed version 2."""
    tx = fx.tx_info(spark, sf_dir)
    matched = joins.restrict_to(tx, fx.binlog_event(spark, sf_dir), small=False)
    first = tx.withColumn("seq", F.lit(1))
    return state.add_versions(first, projections.mark_processed(matched).withColumn("seq", F.lit(2)))


@query
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = state.latest_versions(status_versions(spark, sf_dir))
    return latest.select("gtid", "context", F.col("status").cast("int").alias("status"))


@query
def pending_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = fx.event_tx(spark, sf_dir).withColumn("seq", F.lit(1))
    pending = state.pending_tx(versions, fx.clock("2024-01-31 00:00:00"))
    return pending.select("gtid", "context", _micros("time").alias("time"))


def _micros(time: str) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query
def pending_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as pending transactions, many per gtid: the oldest of each."""
    oldest = aggregates.oldest_per_gtid(fx.user_tx(spark, sf_dir))
    return oldest.select("gtid", "context", _micros("time").alias("time"))


@query
def pending_min_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = filters.unprocessed(fx.event_tx(spark, sf_dir), fx.clock("2024-01-31 00:00:00"))
    return aggregates.min_pending_time(pending).select(_micros("min_time").alias("min_time"))


@query
def pending_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = fx.event_tx(spark, sf_dir).withColumn("seq", F.lit(1))
    return state.backlog(versions, fx.clock("2024-01-31 00:00:00"))


@query
def reconcile_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending transactions of 60 days that have events, as processed."""
    versions = fx.tx_info(spark, sf_dir).withColumn("seq", F.lit(1))
    as_of = fx.clock("2001-08-01 00:00:00")
    pending = state.pending_tx(versions, as_of, hours=60 * 24, limit=None)
    events = joins.restrict_to(fx.binlog_event(spark, sf_dir), pending)
    done = records.audit_records(projections.mark_processed(pending), events)
    return done.select("gtid", "context", "n_events", F.lit(2).alias("status"))


def two_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two notices of every transaction with a context each; the second of every other one is done."""
    first = fx.tx_info(spark, sf_dir).withColumn("seq", F.lit(1))
    second = first.withColumn("context", F.concat("context", F.lit("+")))
    later = F.expr("time + INTERVAL 1 HOUR").cast(first.schema["time"].dataType)
    second = second.withColumn("time", later)
    done = second.where(F.pmod(F.element_at(F.split("gtid", ":"), -1).cast("bigint"), F.lit(2)) == 0)
    versions = state.add_versions(first, second)
    return state.add_versions(versions, done.withColumns({"status": F.lit(2), "seq": F.lit(2)}))


@query
def reconcile_two_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every pending notice that has events, whatever the other notice's status."""
    as_of = fx.clock("2001-08-01 00:00:00")
    pending = state.pending_notices(two_notices(spark, sf_dir), as_of, hours=60 * 24)
    events = joins.restrict_to(fx.binlog_event(spark, sf_dir), pending)
    done = records.audit_records(pending, events)
    return done.select("gtid", "context", "n_events")


@query
def retention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = state.retained(fx.binlog_event(spark, sf_dir), fx.clock("2001-11-04 00:00:00"), 30)
    return kept.select("gtid", "table", "action", "data")


@query
def retention_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = state.retained(fx.tx_info(spark, sf_dir), fx.clock("2001-08-01 00:00:00"), 60)
    return kept.select("gtid", "context")


@query
def complete_by_expected_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx, events = fx.tx_info(spark, sf_dir), fx.binlog_event(spark, sf_dir)
    expected = {context_type: 3 for context_type in range(1, 6)}
    complete = completeness.complete_tx(tx, events, EXPECTED_COUNT, expected)
    return complete.select("gtid", "context", "n_events")


@query
def complete_by_quiescence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups whose user did nothing during the last six hours before the end."""
    events = fx.user_events(spark, sf_dir).withColumn("ingest_time", F.col("event_time"))
    as_of = fx.clock("2024-01-31 00:00:00")
    complete = completeness.complete_tx(
        fx.user_tx(spark, sf_dir), events, QUIESCENT, as_of=as_of, quiet_seconds=6 * 3600
    )
    return complete.select("gtid", "context", "n_events")


@query
def event_counts_by_table_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.counts_by_table_action(
        fx.binlog_event(spark, sf_dir), tm.day_value("time")
    )


@query
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.event_counts(fx.binlog_event(spark, sf_dir))


@query
def ingest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.make_dt_interval(secs=(F.col("event_id") % 5000).cast("decimal(18,6)"))
    events = fx.table(spark, sf_dir, "events").select(
        F.lit("web").alias("db"),
        F.col("event_type").alias("table"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + delay).alias("ingest_time"),
    )
    return reports.ingest_lag(events, alert_seconds=3000)


# --- snapshots and bulk load -----------------------------------------------------------


@query
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_snapshot(
        spark, "parquet", {"path": f"{sf_dir}/customer.parquet"},
        ["c_custkey", "c_name", "c_nationkey"],
    )


@query
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = fx.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uuid"),
        F.col("s_name").alias("name"),
        F.lit("").alias("email"),
        F.lit(snapshots.STATUS_NORMAL).alias("status"),
    )
    return snapshots.append_rows(fx.snapshot(spark, sf_dir), suppliers)


@query
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes a short list of keys, then all customers with an order in status P."""
    some = snapshots.soft_delete(fx.snapshot(spark, sf_dir), "uuid", "1", ["2", "3"])
    gone = fx.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "P")
    keys = gone.select(F.col("o_custkey").cast("string").alias("uuid"))
    return snapshots.soft_delete_by(some, "uuid", keys)


@query
def update_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers named after their latest order."""
    updates = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("uuid"),
        F.col("o_orderkey").alias("at"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, "even@example.com").alias("email"),
    )
    return snapshots.update_by_key(
        fx.snapshot(spark, sf_dir), updates, "uuid", ["name", "email"], ["at"]
    )


def _loaded_again(spark: SparkSession, sf_dir: str, text: Column, continued: bool) -> DataFrame:
    folder = new_folder(spark, "bulk")
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", text.alias("text"), "p_size")
    bulk_text.write_bulk_text(parts, folder, continued)
    schema = T.StructType(
        [
            T.StructField("p_partkey", T.LongType(), False),
            T.StructField("text", T.StringType()),
            T.StructField("p_size", T.IntegerType()),
        ]
    )
    loaded = bulk_text.read_bulk_text(spark, folder, schema)
    return loaded.select(
        "p_partkey", "text", "p_size", F.col(bulk_text.BAD_LINE).isNull().alias("fits")
    )


@query
def bulk_text_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, with tabs, line breaks, backslashes and NULLs, written and loaded again."""
    kind = F.col("p_partkey") % 4
    odd = (
        F.when(kind == 0, F.concat(F.lit("a\tb\\"), F.col("p_name")))
        .when(kind == 1, F.concat(F.col("p_name"), F.lit("\n\\t")))
        .when(kind == 2, F.col("p_name"))
    )
    return _loaded_again(spark, sf_dir, odd, continued=False)


@query
def bulk_text_continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, their fields going on over up to seven lines."""
    breaks = F.repeat(F.lit("\n"), (F.col("p_partkey") % 7).cast("int"))
    return _loaded_again(spark, sf_dir, F.concat(F.col("p_name"), breaks, F.lit("\\")), continued=True)


# --- stored tables and delivery ----------------------------------------------------------


@query
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in two batches, the second twice; one batch per kind of table."""
    store = new_folder(spark, "store")
    ingested = F.lit("2024-03-01 12:00:00 UTC").cast("timestamp")
    events = projections.to_stored_event(fx.envelopes(spark, sf_dir), ingested)
    for batch, name in (("a", "line_open"), ("b", "line_fill"), ("b", "line_fill")):
        tables.append_events(events.where(F.col("table") == name), store, batch, "UTC")
    return tables.read_events(spark, store).groupBy("day", "batch", "table", "action").agg(
        F.count("*").alias("n_events")
    )


@query
def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-history job, then a search in the stored records."""
    store = new_folder(spark, "store")
    tx = fx.notices(spark, sf_dir).withColumn("time", F.timestamp_seconds("time"))
    backfill(spark, store, tx, fx.binlog_event(spark, sf_dir), seq=1, tz="UTC")
    stored = records.without_redeliveries(tables.read_audit(spark, store))
    found = records.search_records(
        stored,
        context_type=1,
        start=F.lit("2024-01-01 00:10:00 UTC").cast("timestamp"),
        table="tpch.line_open",
    )
    return found.select(
        "gtid", "context", F.unix_timestamp("time").alias("seconds"), "n_events"
    )


@query
def stored_two_backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two calls of the whole-history job with other transactions of the same days."""
    store = new_folder(spark, "store")
    _backfill_by_flag(spark, sf_dir, store, 0)
    _backfill_by_flag(spark, sf_dir, store, 1)
    return _stored_sizes(spark, store)


@query
def stored_late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written to days that are closed already, then closed again."""
    store = new_folder(spark, "store")
    options = TrailOptions(store, f"{store}/checkpoints", time_zone="UTC")
    _backfill_by_flag(spark, sf_dir, store, 0)
    close_days_before(spark, options, "99991231")
    _backfill_by_flag(spark, sf_dir, store, 1)
    for _ in range(2):
        close_days_before(spark, options, "99991231")
    return _stored_sizes(spark, store)


@query
def stored_replay_after_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An online batch that ran over half of the events, whose days were closed, runs again.

    Records are counted as they are stored, so one that is there twice or lost shows.
    """
    store = new_folder(spark, "store")
    options = TrailOptions(store, f"{store}/checkpoints", time_zone="UTC", polls=0, tx_days=90)
    ingested = F.lit("2024-03-01 12:00:00 UTC").cast("timestamp")
    events = projections.to_stored_event(fx.envelopes(spark, sf_dir), ingested)
    tx = fx.notices(spark, sf_dir).withColumn("time", F.timestamp_seconds("time"))
    odd = F.crc32(F.col("gtid").cast("binary")) % 2 == 1
    for batch, some in (("a", events.where(odd)), ("b", events.where(~odd))):
        tables.append_events(some, store, batch, "UTC", merge=True)
        online.process_tx_batch(spark, options, tx, 7, None, query="q")
        upkeep(spark, options, dt.datetime(2024, 3, 2, tzinfo=UTC))
    latest = state.latest_versions(tables.read_tx_versions(spark, store))
    sizes = tables.read_audit(spark, store).groupBy("gtid").agg(F.sum(F.size("events")).alias("n_events"))
    return latest.join(sizes, "gtid", "left").select(
        "gtid",
        "context",
        F.col("status").cast("int").alias("status"),
        F.coalesce("n_events", F.lit(0).cast("bigint")).alias("n_events"),
    )


def _backfill_by_flag(spark: SparkSession, sf_dir: str, store: str, odd: int) -> None:
    """The even or the odd transactions; both halves together are all of them."""
    tx = fx.notices(spark, sf_dir)
    half = tx.where(F.pmod("time", F.lit(2)) == odd)
    tx = half.withColumn("time", F.timestamp_seconds("time"))
    backfill(spark, store, tx, fx.binlog_event(spark, sf_dir), seq=1, tz="UTC")


def _stored_sizes(spark: SparkSession, store: str) -> DataFrame:
    """Without resolving redeliveries, so a record that is there twice shows."""
    stored = tables.read_audit(spark, store)
    return stored.select("gtid", "context", F.size("events").cast("bigint").alias("n_events"))


@query
def stored_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses as the whole-history job stores them."""
    store = new_folder(spark, "store")
    tx = fx.notices(spark, sf_dir).withColumn("time", F.timestamp_seconds("time"))
    backfill(spark, store, tx, fx.binlog_event(spark, sf_dir), seq=1, tz="UTC")
    latest = state.latest_versions(tables.read_tx_versions(spark, store))
    return latest.select("gtid", "context", F.col("status").cast("int").alias("status"), "month")


@query
def handler_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-record handler that refuses deletions; one outcome per record."""

    def refuse_deletions(record: dict) -> None:
        if any(e["action"] == 2 for e in record["events"]):
            raise ValueError("deletion")

    tx, events = fx.tx_info(spark, sf_dir), fx.binlog_event(spark, sf_dir)
    return handlers.apply_per_record(records.audit_records(tx, events), refuse_deletions)


def refuse_deletions_over(most: int):
    def refuse(record: dict) -> None:
        if sum(e["action"] == 2 for e in record["events"]) > most:
            raise ValueError("deletion")

    return refuse


@query
def handler_failures_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a batch that ran twice, whose days were closed, and of a second round over
    what failed."""
    store = new_folder(spark, "store")
    options = TrailOptions(store, f"{store}/checkpoints", time_zone="UTC", polls=0, tx_days=90)
    ingested = F.lit("2024-03-01 12:00:00 UTC").cast("timestamp")
    events = projections.to_stored_event(fx.envelopes(spark, sf_dir), ingested)
    tables.append_events(events, store, "a", "UTC", merge=True)
    tx = fx.notices(spark, sf_dir).withColumn("time", F.timestamp_seconds("time"))
    handler = handlers.per_record(refuse_deletions_over(0))
    for _ in range(2):
        online.process_tx_batch(spark, options, tx, 7, handler, query="q")
    upkeep(spark, options, dt.datetime(2024, 3, 2, tzinfo=UTC))
    redeliver(spark, options, refuse_deletions_over(1), "second")
    found = tables.read_outcomes(spark, store)
    return found.select("gtid", "context", "part", "call_no", "kind", "error")


# --- streams ---------------------------------------------------------------------------


# A file of messages holds about this many, so that none grows with the input.
MESSAGES_PER_FILE = 250_000
# Messages repeat their field names and ids: they take about a tenth of the disk this way.
COMPRESSED = {"compression": "gzip"}


def files_of(df: DataFrame, least: int) -> int:
    """Number of files for the messages; a count of a projected table reads no columns."""
    return max(least, -(-df.count() // MESSAGES_PER_FILE))


def landed(df: DataFrame, folder: str) -> TopicOptions:
    """Messages written as a folder of compressed text files, at least four, read in two batches."""
    files = files_of(df, 4)
    topics.write_topic(df.repartition(files), "text", {"path": folder, **COMPRESSED})
    return TopicOptions("text", {"path": folder, "maxFilesPerTrigger": str(-(-files // 2))})


def stream_options(spark: SparkSession, sf_dir: str, **more) -> TrailOptions:
    folder = new_folder(spark, "stream")
    return TrailOptions(
        store=f"{folder}/store",
        checkpoints=f"{folder}/checkpoints",
        events_topic=landed(
            topics.encode_events(fx.envelopes(spark, sf_dir)), f"{folder}/binlog"
        ),
        tx_topic=landed(topics.encode_tx(fx.notices(spark, sf_dir)), f"{folder}/tx_info"),
        time_zone="UTC",
        polls=0,
        **more,
    )


ONCE = {"availableNow": True}


@query
def stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw changes of all tables as messages, to the events topic of the included ones."""
    folder = new_folder(spark, "stream")
    raw = fx.raw_changes(spark, sf_dir)
    source = landed(raw.select(F.to_json(F.struct(*raw.columns)).alias("value")), f"{folder}/raw")
    sink = TopicOptions("text", {"path": f"{folder}/binlog", **COMPRESSED})
    options = TrailOptions(f"{folder}/store", f"{folder}/checkpoints", tables=TABLES)
    ingest.start_publish(spark, options, source, sink, ONCE).awaitTermination()
    return spark.read.text(f"{folder}/binlog")


@query
def stream_publish_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions to their topic; messages that are no notice, or have no usable id, apart."""
    folder = new_folder(spark, "stream")
    samples = fx.gtid_samples(spark, sf_dir)
    notice = F.struct((F.col("id") + 1).alias("time"), F.concat(F.lit("id="), "id").alias("context"), "gtid")
    message = F.when(F.col("id") % 7 == 3, F.concat(F.lit("no notice "), "id")).otherwise(F.to_json(notice))
    source = landed(samples.select(message.alias("value")), f"{folder}/commits")
    options = TrailOptions(f"{folder}/store", f"{folder}/checkpoints")
    ingest.start_publish_tx(spark, options, source, TopicOptions("text", {"path": f"{folder}/tx_info"}), ONCE).awaitTermination()
    ingest.start_tx_rejects(spark, options, source, ONCE).awaitTermination()
    sent = spark.read.text(f"{folder}/tx_info").withColumn("reason", F.lit(None).cast("string"))
    left_out = spark.read.schema("reason string, value string").json(ingest.quarantine_path(options.store, "unpublished_tx"))
    every = sent.unionByName(left_out)
    told = F.from_json("value", "time bigint, context string, gtid string")
    return every.select(
        "reason",
        F.when(F.coalesce("reason", F.lit("")) == ingest.UNDECODABLE, F.col("value")).alias("message"),
        told["time"].alias("seconds"),
        told["context"].alias("context"),
        told["gtid"].alias("gtid"),
    )


@query
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = stream_options(spark, sf_dir)
    ingest.start_ingest(spark, options, ONCE).awaitTermination()
    return tables.read_events(spark, options.store).select(
        "db", "table", "action", "gtid", "data",
        F.unix_timestamp("event_time").alias("event_seconds"),
    )


def stored_outcome(spark: SparkSession, store: str) -> DataFrame:
    """Every transaction with its latest status and the events of its record."""
    latest = state.latest_versions(tables.read_tx_versions(spark, store))
    found = records.without_redeliveries(tables.read_audit(spark, store))
    sizes = found.groupBy("gtid").agg(
        F.sum(F.size("events")).alias("n_events")
    )
    return latest.join(sizes, "gtid", "left").select(
        "gtid",
        "context",
        F.col("status").cast("int").alias("status"),
        F.coalesce("n_events", F.lit(0).cast("bigint")).alias("n_events"),
    )


@query
def stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events first, then transactions, both from their topics."""
    options = stream_options(spark, sf_dir)
    ingest.start_ingest(spark, options, ONCE).awaitTermination()
    online.start_online(spark, options, None, ONCE).awaitTermination()
    return stored_outcome(spark, options.store)


@query
def stream_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions arrive before any event; one reconcile finds the events later."""
    options = stream_options(spark, sf_dir, pending_limit=None)
    online.start_online(spark, options, None, ONCE).awaitTermination()
    ingest.start_ingest(spark, options, ONCE).awaitTermination()
    as_of = dt.datetime(2024, 1, 1, tzinfo=UTC)
    # later than the statuses written above, but with a lookback that reaches all notices
    hours = int((dt.datetime.now(UTC) - as_of).total_seconds() // 3600) + 48
    options = TrailOptions(**{**vars(options), "lookback_hours": hours})
    reconcile.reconcile_once(spark, options, 0)
    return stored_outcome(spark, options.store)


KEYED_MESSAGES = T.StructType(
    [
        T.StructField("gtid", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("arrived", T.TimestampType()),
    ]
)


@query
def stream_online_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All notices, events of odd transactions in time, the others after the grace, then nothing
    until the lookback has passed; the query stops and starts again in between."""
    folder = new_folder(spark, "stream")
    tx = fx.notices(spark, sf_dir).withColumn("time", F.timestamp_seconds("time"))
    events = fx.envelopes(spark, sf_dir).select("gtid")
    odd = F.substring_index("gtid", ":", -1).cast("bigint") % 2 == 1

    def arrived(df: DataFrame, at: str) -> DataFrame:
        return df.withColumn("arrived", F.lit(f"2024-03-0{at} UTC").cast("timestamp"))

    clock = spark.createDataFrame([("clock",)], "gtid string")
    steps = [
        keyed.messages(arrived(tx, "1 12:00:00"), arrived(events.where(odd), "1 12:00:00")),
        keyed.messages(arrived(tx.limit(0), "1 12:00:00"), arrived(clock, "1 12:10:00")),
        keyed.messages(arrived(tx.limit(0), "1 12:00:00"), arrived(events.where(~odd), "1 13:00:00")),
        keyed.messages(arrived(tx.limit(0), "1 12:00:00"), arrived(clock, "5 12:00:00")),
    ]
    files = files_of(tx, 8), files_of(events, 8)
    for n, step in enumerate(steps):
        step.repartition(max(files)).write.mode("append").parquet(f"{folder}/messages/{n}")
        stream = spark.readStream.schema(KEYED_MESSAGES).parquet(f"{folder}/messages/*")
        decided = drained(keyed.outcomes(stream), folder)
    # the id of the clock is no transaction
    return decided.where(F.col("gtid") != "clock").select("gtid", "context", "outcome", "n_events")


def timed_stream(
    df: DataFrame, folder: str, time: str, schema: T.StructType
) -> DataFrame:
    """A stream of `df` in order of time, closed by one row far beyond it.

    The last row moves the watermark past all others, so that they are emitted. It
    has an id of its own and is dropped from the results.
    """
    spark = df.sparkSession
    stamped = df.withColumn(time, F.col(time).cast("timestamp"))
    stamped.write.parquet(f"{folder}/1")
    last = stamped.agg(F.max(time).alias(time)).select(
        *[
            (F.col(time) + F.expr("INTERVAL 30 DAYS")).alias(time)
            if f.name == time
            else F.lit("clock" if f.name == "gtid" else None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
    last.write.parquet(f"{folder}/2")
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1_000)
        .parquet(f"{folder}/*")
    )


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Result of a finite stream, written as it is emitted."""
    spark = stream.sparkSession
    query_ = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoints")
        .outputMode("append")
        .trigger(**ONCE)
        .start()
    )
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


TX_STREAM = T.StructType(
    [
        T.StructField("gtid", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("time", T.TimestampType()),
    ]
)
EVENT_STREAM = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
    ]
)


@query
def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups with what the user did within six hours around them, or without."""
    folder = new_folder(spark, "stream")
    tx = timed_stream(fx.user_tx(spark, sf_dir), f"{folder}/tx", "time", TX_STREAM)
    events = timed_stream(
        fx.user_events(spark, sf_dir), f"{folder}/events", "event_time", EVENT_STREAM
    )
    joined = stream_joins.correlate_streams(tx, events, "6 hours", "1 hour")
    return (
        drained(joined, folder)
        .where(F.col("gtid") != "clock")
        .select("gtid", "context", "table", "data", _micros("event_time").alias("event_time"))
    )


@query
def stream_quiescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of user activity followed by at least six quiet hours."""
    folder = new_folder(spark, "stream")
    events = timed_stream(
        fx.user_events(spark, sf_dir), f"{folder}/events", "event_time", EVENT_STREAM
    )
    groups = stream_joins.quiescent_groups(events, "6 hours", "1 hour")
    return (
        drained(groups, folder)
        .where(F.col("gtid") != "clock")
        .select(
            "gtid",
            _micros("first_time").alias("first_time"),
            _micros("last_time").alias("last_time"),
            "n_events",
        )
    )


LAG_STREAM = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("gtid", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("ingest_time", T.TimestampType()),
    ]
)


@query
def stream_lag_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come up to 5000 s late every third day, checked each hour over two hours."""
    folder = new_folder(spark, "stream")
    late = F.when(F.dayofmonth("ts") % 3 == 0, F.col("event_id") % 5000).otherwise(F.col("event_id") % 100)
    events = fx.table(spark, sf_dir, "events").select(
        F.lit("web").alias("db"),
        F.col("event_type").alias("table"),
        F.lit("").alias("gtid"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.make_dt_interval(secs=late.cast("decimal(18,6)"))).alias("ingest_time"),
    )
    stream = timed_stream(events, f"{folder}/events", "ingest_time", LAG_STREAM)
    checks = lag.lag_checks(stream, "2 hours", "1 hour")
    lag.write_checks(checks, folder, f"{folder}/checkpoints", ONCE).awaitTermination()
    stored = lag.read_checks(spark, folder)
    alerts = lag.lag_alerts(stored, threshold_seconds=3000, raise_after=3, clear_after=2)
    lag.write_alerts(alerts, folder, f"{folder}/checkpoints", ONCE).awaitTermination()
    return spark.read.schema(lag.ALERT).json(lag.alerts_path(folder)).select(
        "db", "table", F.date_format("checked", "yyyy-MM-dd HH:mm").alias("checked"), "alert", "max_lag_seconds"
    )
