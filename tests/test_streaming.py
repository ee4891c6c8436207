import base64
import datetime as dt
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import txtrail
from txtrail.options import TopicOptions, TrailOptions
from txtrail.operators import state
from txtrail.plans import jobs
from txtrail.session import SHUFFLE_CLEANUP
from txtrail.sources import handlers, tables
from txtrail.sources.topics import encode_events, encode_tx
from txtrail.streaming import ingest, online, reconcile
from txtrail.streaming import joins as stream_joins

UTC = dt.timezone.utc
NOW = dt.datetime.now(UTC).replace(microsecond=0)
ONCE = {"availableNow": True}
EVENT = "db string, `table` string, action int, gtid string, time bigint, data string"
TX = "time bigint, context string, gtid string"


@pytest.fixture
def options(tmp_path):
    for name in ("binlog", "tx_info"):
        (tmp_path / name).mkdir()
    return TrailOptions(
        store=str(tmp_path / "store"),
        checkpoints=str(tmp_path / "checkpoints"),
        events_topic=TopicOptions("text", {"path": str(tmp_path / "binlog")}),
        tx_topic=TopicOptions("text", {"path": str(tmp_path / "tx_info")}),
        time_zone="UTC",
        polls=0,
    )


def send(topic: TopicOptions, df):
    df.coalesce(1).write.mode("append").text(topic.options["path"])


def send_events(spark, options, *gtids):
    rows = [("d", "t", 0, g, int(NOW.timestamp()), json.dumps({"n": n})) for n, g in enumerate(gtids)]
    send(options.events_topic, encode_events(spark.createDataFrame(rows, EVENT)))


def send_tx(spark, options, *notices):
    rows = [(int(NOW.timestamp()), context, gtid) for gtid, context in notices]
    send(options.tx_topic, encode_tx(spark.createDataFrame(rows, TX)))


def statuses(spark, options):
    latest = state.latest_versions(tables.read_tx_versions(spark, options.store))
    return {(r.gtid, r.status) for r in latest.collect()}


def record_sizes(spark, options):
    return sorted((r.gtid, r.context, len(r.events)) for r in txtrail.Trail(spark, options).records().collect())


def test_bad_messages_are_kept_apart(spark, options):
    send_events(spark, options, "a", "b")
    send(options.events_topic, spark.createDataFrame([("not json",)], "value string"))
    ingest.start_ingest(spark, options, ONCE).awaitTermination()
    assert sorted(r.gtid for r in tables.read_events(spark, options.store).collect()) == ["a", "b"]
    path = ingest.quarantine_path(options.store, "events")
    assert [r.value for r in spark.read.text(path).collect()] == ["not json"]


def test_restart_goes_on_where_it_stopped(spark, options):
    for gtid in "abc":
        send_events(spark, options, gtid)
        ingest.start_ingest(spark, options, ONCE).awaitTermination()
    assert sorted(r.gtid for r in tables.read_events(spark, options.store).collect()) == ["a", "b", "c"]


def test_online_then_reconcile(spark, options):
    send_events(spark, options, "a", "a", "b")
    send_tx(spark, options, ("a", "1.x."), ("a", "1.y."), ("b", "1.."), ("late", "1.."), ("never", "1.."))
    seen = []
    trail = txtrail.build(spark, options)
    trail.run_available(lambda df, batch: seen.extend(r.gtid for r in df.collect()))
    assert sorted(seen) == ["a", "a", "b"]
    assert record_sizes(spark, options) == [("a", "1.x.", 2), ("a", "1.y.", 2), ("b", "1..", 1)]
    assert statuses(spark, options) == {("a", 2), ("b", 2), ("late", 1), ("never", 1)}

    send_events(spark, options, "late", "late")
    ingest.start_ingest(spark, options, ONCE).awaitTermination()
    assert reconcile.reconcile_once(spark, options, 0, lambda df, batch: seen.append("again"))
    assert seen[-1] == "again"
    assert record_sizes(spark, options)[-1] == ("late", "1..", 2)
    assert statuses(spark, options) == {("a", 2), ("b", 2), ("late", 2), ("never", 1)}
    # nothing new: only `never` is looked at again
    assert reconcile.reconcile_once(spark, options, 1)
    assert len(record_sizes(spark, options)) == 4
    beyond = NOW + dt.timedelta(hours=100)
    assert not reconcile.reconcile_once(spark, options, 2, as_of=beyond)


def test_replayed_batch_changes_nothing(spark, options):
    send_events(spark, options, "a", "b", "b")
    ingest.start_ingest(spark, options, ONCE).awaitTermination()
    tx = spark.createDataFrame(
        [(NOW, "1..", "a"), (NOW, "1..", "a"), (NOW, "1..", "b"), (NOW, "1..", "c")],
        "time timestamp, context string, gtid string",
    )
    for _ in range(2):
        online.process_tx_batch(spark, options, tx, 7, None)
        # the notice of `a` was delivered twice and is one record
        assert record_sizes(spark, options) == [("a", "1..", 1), ("b", "1..", 2)]
        assert statuses(spark, options) == {("a", 2), ("b", 2), ("c", 1)}


def test_large_transaction_comes_in_parts(spark, options):
    options = TrailOptions(**{**vars(options), "max_events_per_row": 8})
    send_events(spark, options, *["big"] * 50, "small")
    send_tx(spark, options, ("big", "1.."), ("small", "1.."))
    txtrail.build(spark, options).run_available()
    rows = tables.read_audit(spark, options.store).collect()
    assert sum(len(r.events) for r in rows if r.gtid == "big") == 50
    assert {r.n_events for r in rows if r.gtid == "big"} == {50}
    assert len([r for r in rows if r.gtid == "big"]) > 1
    assert statuses(spark, options) == {("big", 2), ("small", 2)}


@pytest.mark.parametrize("mode, complete", [
    ("any", {"two", "one"}), ("expected_count", {"two"}), ("quiescent", set()),
])
def test_completeness_decides_what_stays_pending(spark, options, mode, complete):
    options = TrailOptions(**{
        **vars(options), "completeness": mode, "expected_counts": {1: 2}, "quiet_seconds": 3600,
    })
    send_events(spark, options, "two", "two", "one")
    send_tx(spark, options, ("two", "1.."), ("one", "1.."), ("one", "2.."))
    txtrail.build(spark, options).run_available()
    processed = {g for g, s in statuses(spark, options) if s == 2}
    assert processed == complete


def test_lookback_by_ingest_day_keeps_recent_events(spark, options):
    options = TrailOptions(**{**vars(options), "ingest_margin_hours": 48})
    send_events(spark, options, "a")
    send_tx(spark, options, ("a", "1.."))
    txtrail.build(spark, options).run_available()
    assert statuses(spark, options) == {("a", 2)}


def test_failing_handler_does_not_stop_the_job(spark, options):
    send_events(spark, options, "a")
    send_tx(spark, options, ("a", "1.."))

    def broken(df, batch):
        raise RuntimeError("no")

    txtrail.build(spark, options).run_available(broken)
    assert statuses(spark, options) == {("a", 2)}


def test_per_record_handler_isolates_failures(spark, options, caplog):
    send_events(spark, options, "a", "b")
    send_tx(spark, options, ("a", "1.."), ("b", "1.."))

    def fussy(record):
        if record["gtid"] == "b":
            raise ValueError("not b")

    txtrail.build(spark, options).run_available(handlers.per_record(fussy))
    assert statuses(spark, options) == {("a", 2), ("b", 2)}
    rows = handlers.apply_per_record(tables.read_audit(spark, options.store), fussy).collect()
    assert {(r.gtid, r.error) for r in rows} == {("a", None), ("b", "ValueError: not b")}


def test_outcomes_of_calls_are_stored_and_failures_delivered_again(spark, options, caplog):
    send_events(spark, options, "a", "b")
    send_tx(spark, options, ("a", "1.."), ("b", "1.."))

    def fussy(record):
        if record["gtid"] == "b":
            raise ValueError("not b")

    trail = txtrail.build(spark, options)
    trail.run_available(handlers.per_record(fussy))
    shown = ["gtid", "part", "call_no", "kind", "error"]
    first = {("a", 0, 1, None, None), ("b", 0, 1, "ValueError", "ValueError: not b")}
    assert {tuple(r) for r in trail.outcomes().select(*shown).collect()} == first
    times = trail.outcomes().join(trail.records(), ["gtid", "context", "time"])
    assert times.count() == 2 and times.where("called < time").isEmpty()
    logged = [r.getMessage() for r in caplog.records if "calls failed" in r.getMessage()]
    assert len(logged) == 1 and "1 calls failed with ValueError" in logged[0]

    def broken(record):
        raise KeyError("call_no" in record)

    # only what failed is called again; the same round twice is stored once
    for _ in range(2):
        jobs.redeliver(spark, options, broken, "again")
    second = first | {("b", 0, 2, "KeyError", "KeyError: False")}
    assert sorted(map(str, trail.outcomes().select(*shown).collect())) == sorted(str(Row(**dict(zip(shown, x)))) for x in second)
    jobs.upkeep(spark, options)
    jobs.redeliver(spark, options, lambda record: None, "last")
    assert {tuple(r) for r in trail.outcomes().select(*shown).collect()} == second | {("b", 0, 3, None, None)}
    jobs.redeliver(spark, options, broken, "nothing left")
    assert trail.outcomes().count() == 4


def test_records_without_an_outcome_are_delivered_when_asked_for(spark, options):
    send_events(spark, options, "a")
    send_tx(spark, options, ("a", "1.."))
    trail = txtrail.build(spark, options)
    trail.run_available()
    assert trail.outcomes().isEmpty()
    jobs.redeliver(spark, options, lambda record: None, "failed ones")
    assert trail.outcomes().isEmpty()
    jobs.redeliver(spark, options, lambda record: None, "all", missing=True)
    assert [(r.gtid, r.call_no, r.error) for r in trail.outcomes().collect()] == [("a", 1, None)]


def test_print_handler(spark, options, capfd):
    send_events(spark, options, "a")
    send_tx(spark, options, ("a", "1.."))
    txtrail.build(spark, options).run_available(handlers.print_records)
    assert '"gtid":"a"' in capfd.readouterr().out


def test_jobs_run_until_stopped(spark, options):
    options = TrailOptions(**{**vars(options), "recheck_interval": 1.0, "flush_interval": 0.5})
    send_events(spark, options, "a")
    queries = txtrail.run(spark, options)
    try:
        assert sorted(q.name for q in queries) == ["ingest", "online", "reconcile", "upkeep"]
        queries[0].processAllAvailable()
        send_tx(spark, options, ("a", "1.."), ("b", "1.."))
        queries[1].processAllAvailable()
        send_events(spark, options, "b")
        queries[0].processAllAvailable()
        deadline = dt.datetime.now() + dt.timedelta(seconds=60)
        while statuses(spark, options) != {("a", 2), ("b", 2)} and dt.datetime.now() < deadline:
            queries[2].awaitTermination(1)
    finally:
        for query in queries:
            query.stop()
    assert all(q.exception() is None for q in queries)
    assert statuses(spark, options) == {("a", 2), ("b", 2)}


def test_events_that_come_late_within_the_polls_are_found(spark, options, monkeypatch):
    options = TrailOptions(**{**vars(options), "polls": 3, "poll_interval": 0.0})
    looks = []
    real = online.candidate_events

    def candidates(*args):
        looks.append(1)
        if len(looks) == 3:
            send_events(spark, options, "a")
            ingest.start_ingest(spark, options, ONCE).awaitTermination()
        return real(*args)

    monkeypatch.setattr(online, "candidate_events", candidates)
    tx = spark.createDataFrame([(NOW, "1..", "a")], "time timestamp, context string, gtid string")
    online.process_tx_batch(spark, options, tx, 0, None)
    assert len(looks) == 3
    assert statuses(spark, options) == {("a", 2)}


def test_quiescent_groups_in_batch_equal_the_stream(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("g", at + dt.timedelta(seconds=s)) for s in (0, 1, 2, 60, 61)] + [("h", at)]
    df = spark.createDataFrame(rows, "gtid string, event_time timestamp")
    groups = stream_joins.quiescent_groups(df, "10 seconds").collect()
    assert sorted((r.gtid, r.n_events) for r in groups) == [("g", 2), ("g", 3), ("h", 1)]


def test_topic_values_are_the_same_for_stream_and_table(spark, tmp_path):
    raw = spark.createDataFrame(
        [(json.dumps({"db": "d", "table": t, "event_type": e, "gtid_set": "g", "timestamp": 1,
                      "before": {}, "after": {"n": 1, "s": "x"}}),)
         for t, e in (("t", "insert"), ("u", "insert"), ("t", "ddl"))],
        "value string",
    )
    send(TopicOptions("text", {"path": str(tmp_path / "raw")}), raw)
    options = TrailOptions(str(tmp_path / "s"), str(tmp_path / "c"), tables=["d.t"])
    source = TopicOptions("text", {"path": str(tmp_path / "raw")})
    sink = TopicOptions("text", {"path": str(tmp_path / "out")})
    send(source, spark.createDataFrame([("broken",)], "value string"))
    ingest.start_publish(spark, options, source, sink, ONCE).awaitTermination()
    ingest.start_raw_quarantine(spark, options, source, ONCE).awaitTermination()
    kept = spark.read.text(ingest.quarantine_path(options.store, "raw"))
    assert [r.value for r in kept.collect()] == ["broken"]
    (message,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert base64.b64decode(message["data"]) == b'{"before":{},"after":{"n":1,"s":"x"}}'
    assert (message["db"], message["table"], message["action"]) == ("d", "t", 0)


def test_landed_messages_make_more_files_when_there_are_more(spark, tmp_path, monkeypatch):
    from txtrail.plans import catalog

    monkeypatch.setattr(catalog, "MESSAGES_PER_FILE", 100)
    messages = spark.range(1000).selectExpr("CAST(id AS STRING) AS value")
    topic = catalog.landed(messages, str(tmp_path / "many"))
    assert len(list((tmp_path / "many").glob("part-*"))) == 10
    # still two batches
    assert topic.options["maxFilesPerTrigger"] == "5"
    assert catalog.landed(messages.limit(5), str(tmp_path / "few")).options["maxFilesPerTrigger"] == "2"


def test_messages_take_little_disk_and_leave_no_shuffle_behind(spark, tmp_path):
    from txtrail.plans import catalog

    lines = spark.range(5000).selectExpr(
        "id AS l_orderkey", "id AS l_partkey", "1 AS l_linenumber", "'A' AS l_returnflag",
        "'O' AS l_linestatus", "timestamp_ntz '2024-01-01 00:00:00' AS l_shipdate",
    )
    orders = spark.range(5).selectExpr(
        "id AS o_orderkey", "'O' AS o_orderstatus", "timestamp_ntz '2024-01-01 00:00:00' AS o_orderdate"
    )
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    published = catalog.stream_publish(spark, str(tmp_path))
    files = [f.removeprefix("file://") for f in published.inputFiles()]
    told = published.selectExpr("sum(length(value))").first()[0]
    assert published.count() == 5000
    assert sum(os.path.getsize(f) for f in files) < told / 4
    landed = files[0].rsplit("/", 2)[0] + "/raw"
    assert sum(p.stat().st_size for p in Path(landed).glob("part-*")) < told / 4

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    catalog.landed(spark.range(100).selectExpr("CAST(id AS STRING) AS value"), str(tmp_path / "some"))
    assert tracker.shuffleStatuses().size() <= before
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None


def test_second_round_writes_few_files_a_day(spark, options):
    """Failed calls of many days, called again by several tasks."""
    day, days = 86_400, 6
    rows = [(int(NOW.timestamp()) - (n % days) * day, "1..", f"s:{n}") for n in range(120)]
    send_events(spark, options, *[f"s:{n}" for n in range(120)])
    send(options.tx_topic, encode_tx(spark.createDataFrame(rows, TX)))

    def broken(record):
        raise KeyError(record["gtid"])

    trail = txtrail.build(spark, options)
    trail.run_available(handlers.per_record(broken))
    several = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key, None) for key in several}
    try:
        for key, value in several.items():
            spark.conf.set(key, value)
        jobs.redeliver(spark, options, broken, "again")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    again = tables.read_outcomes(spark, options.store, "again")
    assert sorted(r.gtid for r in again.collect()) == sorted(f"s:{n}" for n in range(120))
    assert again.where("call_no = 2 AND kind = 'KeyError'").count() == 120
    assert len(again.inputFiles()) == days


def test_candidate_events_are_not_copied_to_disk(spark, options):
    send_events(spark, options, "a")
    txtrail.build(spark, options).run_available()
    tx = spark.createDataFrame([("a", "1..", NOW)], "gtid string, context string, time timestamp")
    events = online.wait_for_events(spark, options, tx)
    assert events.count() == 1
    assert events.storageLevel.useMemory and not events.storageLevel.useDisk
    events.unpersist()


def test_topics_of_the_registered_streams_are_compressed(spark, tmp_path):
    from txtrail.plans import catalog

    at = "timestamp_ntz '2024-01-01 00:00:00'"
    spark.range(4000).selectExpr(
        "id % 1000 AS l_orderkey", "id AS l_partkey", "1 AS l_linenumber", "'N' AS l_returnflag",
        "'F' AS l_linestatus", f"{at} AS l_shipdate",
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(1000).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority",
        f"{at} AS o_orderdate",
    ).write.parquet(str(tmp_path / "orders.parquet"))
    options = catalog.stream_options(spark, str(tmp_path))
    for topic, n in ((options.events_topic, 4000), (options.tx_topic, 1000)):
        folder = topic.options["path"]
        told = spark.read.text(folder).selectExpr("count(*) AS n", "sum(length(value)) AS length").first()
        assert told.n == n
        assert sum(p.stat().st_size for p in Path(folder).glob("part-*")) < told.length / 3


def test_reconcile_copies_nothing_to_disk(spark, options, monkeypatch):
    levels, correlate = [], reconcile.correlate

    def seen(spark, options, tx, events, *more):
        levels.append(events.storageLevel)
        return correlate(spark, options, tx, events, *more)

    monkeypatch.setattr(reconcile, "correlate", seen)
    send_tx(spark, options, ("a", "1.."))
    txtrail.build(spark, options).run_available()
    send_events(spark, options, "a")
    ingest.start_ingest(spark, options, ONCE).awaitTermination()
    assert reconcile.reconcile_once(spark, options, 0)
    assert statuses(spark, options) == {("a", 2)}
    assert levels and not any(level.useDisk for level in levels)
