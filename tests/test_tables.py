import datetime as dt

import pytest
from pyspark.sql import functions as F

from txtrail.operators import filters, joins, records, state
from txtrail.options import TrailOptions
from txtrail.plans import jobs, reports
from txtrail.session import new_folder
from txtrail.sources import tables

UTC = dt.timezone.utc
SERVER = "3e11fa47-71ca-11e1-9e33-c80aa9429562"


def stored(spark, n=100, at="2024-03-01 12:00:00 UTC", server=SERVER):
    return spark.range(n).select(
        F.lit("d").alias("db"),
        F.lit("t").alias("table"),
        F.lit(0).alias("action"),
        F.concat(F.lit(f"{server}:"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("gtid"),
        F.col("id").cast("string").alias("data"),
        F.lit(at).cast("timestamp").alias("event_time"),
        F.lit(at).cast("timestamp").alias("ingest_time"),
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replayed_batch_replaces_itself(spark, tmp_path):
    store = str(tmp_path)
    tables.append_events(stored(spark), store, "1", "UTC")
    tables.append_events(stored(spark), store, "2", "UTC", merge=True)
    tables.append_events(stored(spark), store, "2", "UTC", merge=True)
    assert tables.read_events(spark, store).groupBy("batch").count().orderBy("batch").collect() == [
        ("1", 100), ("2", 100),
    ]


def test_day_is_taken_in_the_given_zone(spark, tmp_path):
    late = stored(spark, 1, "2024-02-29 20:00:00 UTC")
    tables.append_events(late, str(tmp_path), "1", "Asia/Shanghai")
    assert tables.read_events(spark, str(tmp_path)).first().day == "20240301"


def test_missing_table_is_empty(spark, tmp_path):
    assert tables.read_events(spark, str(tmp_path / "none")).count() == 0
    assert tables.read_audit(spark, str(tmp_path / "none")).columns[-1] == "batch"


def test_lookup_reaches_the_scan(spark, tmp_path):
    tables.append_events(stored(spark), str(tmp_path), "1", "UTC")
    events = tables.read_events(spark, str(tmp_path))
    one = filters.events_of(events, f"{SERVER}:000007")
    assert one.count() == 1
    assert f"EqualTo(gtid,{SERVER}:000007)" in plan_of(one)
    day = events.where(F.col("day") >= "20240301")
    assert "PartitionFilters: [isnotnull(day" in plan_of(day)


def test_few_keys_are_broadcast_and_prune_by_range(spark, tmp_path):
    tables.append_events(stored(spark), str(tmp_path), "1", "UTC")
    events = tables.read_events(spark, str(tmp_path))
    found = joins.restrict_to(events, stored(spark, 10))
    assert found.count() == 10
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan
    assert f"GreaterThanOrEqual(gtid,{SERVER}:000000)" in plan
    assert f"(gtid#" in plan and f"<= {SERVER}:000009" in plan
    assert joins.restrict_to(events, stored(spark, 0)).count() == 0
    many = stored(spark, 10).withColumn("gtid", F.concat("data", F.lit(":1")))
    assert joins.id_ranges(many.unionByName(stored(spark, 100).withColumn(
        "gtid", F.concat(F.lit("s"), "data", F.lit(":1"))))) is None


def test_filter_on_month_reaches_the_scan_below_the_latest_versions(spark, tmp_path):
    tx = stored(spark, 5).select(
        "gtid", F.lit("1..").alias("context"), F.col("event_time").alias("time"),
        F.lit(1).alias("status"), F.lit(1).alias("seq"),
    )
    tables.append_tx(tx, str(tmp_path), "online", "1", "UTC")
    as_of = F.lit(dt.datetime(2024, 3, 2, tzinfo=UTC)).cast("timestamp")
    pending = state.pending_tx(tables.read_tx_versions(spark, str(tmp_path)), as_of)
    assert pending.count() == 5
    assert "PartitionFilters: [isnotnull(month" in plan_of(pending)


def test_closed_day_has_the_same_rows_in_narrow_files(spark, tmp_path):
    options = TrailOptions(str(tmp_path), str(tmp_path / "ck"), time_zone="UTC")
    path = tables.event_path(options.store)
    for batch, at in enumerate(["2024-03-01 12:00:00 UTC"] * 3 + ["2024-03-02 12:00:00 UTC"]):
        tables.append_events(stored(spark, 100, at), options.store, str(batch), "UTC")
    before = tables.read_events(spark, options.store).persist()
    assert before.count() == 400
    tables.close_day(spark, path, "20240301", rows_per_file=100)
    assert tables.closed_days(spark, path) == ["20240301"]
    after = tables.read_events(spark, options.store)
    assert after.count() == 400
    assert after.exceptAll(before).isEmpty() and before.exceptAll(after).isEmpty()
    closed = after.where("day = '20240301'")
    ranges = closed.groupBy(F.input_file_name()).agg(F.min("gtid"), F.max("gtid")).collect()
    assert len(ranges) == 3
    bounds = sorted((r[1], r[2]) for r in ranges)
    assert all(bounds[i][1] <= bounds[i + 1][0] for i in range(2))
    # the next closing leaves the closed day alone
    assert jobs.close_days_before(spark, options, "20240303") == ["20240302"]
    assert tables.open_days(spark, path) == []
    assert tables.vacuum(spark, path, keep_hours=1) == []
    assert tables.vacuum(spark, path, keep_hours=0) == ["20240301", "20240302"]
    again = tables.read_events(spark, options.store)
    assert again.exceptAll(before).isEmpty() and again.count() == 400
    before.unpersist()


def test_closed_day_takes_later_batches(spark, tmp_path):
    options = TrailOptions(str(tmp_path), str(tmp_path / "ck"), time_zone="UTC")
    path = tables.event_path(options.store)

    def sizes():
        rows = tables.read_events(spark, options.store).groupBy("batch").count().collect()
        return {r["batch"]: r["count"] for r in rows}

    tables.append_events(stored(spark, 10), options.store, "a", "UTC")
    assert jobs.close_days_before(spark, options, "20240302") == ["20240301"]
    assert jobs.close_days_before(spark, options, "20240302") == []
    tables.append_events(stored(spark, 20), options.store, "b", "UTC")
    assert sizes() == {"a": 10, "b": 20}
    # a late batch is closed with the others, and nothing is there twice in between
    assert jobs.close_days_before(spark, options, "20240302") == ["20240301"]
    assert sizes() == {"a": 10, "b": 20}
    tables.append_events(stored(spark, 30), options.store, "c", "UTC")
    assert tables.vacuum(spark, path, 0) == ["20240301"]
    assert sizes() == {"a": 10, "b": 20, "c": 30}
    assert tables.open_days(spark, path) == ["20240301"]
    # the replay of a batch that is closed changes nothing
    tables.append_events(stored(spark, 10), options.store, "a", "UTC")
    assert sizes() == {"a": 10, "b": 20, "c": 30}


def test_unfinished_rewrite_is_not_read(spark, tmp_path):
    store = str(tmp_path)
    tables.append_events(stored(spark), store, "1", "UTC")
    tables.compact(tables.read_events(spark, store), str(tmp_path / "binlog_event" / "attempt=x" / "day=20240301"))
    assert tables.read_events(spark, store).count() == 100


def test_compaction_splits_one_gtid(spark, tmp_path):
    events = stored(spark, 1000).withColumn("gtid", F.lit("g")).withColumn("data", F.lit("same"))
    store, out = str(tmp_path / "a"), str(tmp_path / "b")
    tables.append_events(events, store, "1", "UTC")
    tables.compact(tables.read_events(spark, store), out, rows_per_file=250)
    sizes = [r["count"] for r in spark.read.parquet(out).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 4 and max(sizes) < 500


def test_bucketed_tables_are_joined_without_a_shuffle(spark, tmp_path):
    events = stored(spark)
    tx = events.select(F.col("event_time").alias("time"), F.lit("1..").alias("context"), "gtid")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables.save_bucketed(events, "bucketed_events", str(tmp_path / "e"), 4)
        tables.save_bucketed(tx, "bucketed_tx", str(tmp_path / "t"), 4)
        joined = joins.matched_long(spark.table("bucketed_tx"), spark.table("bucketed_events"))
        assert joined.count() == 100
        assert "Exchange hashpartitioning" not in plan_of(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_events")
        spark.sql("DROP TABLE IF EXISTS bucketed_tx")


def test_merged_versions_resolve_to_the_same(spark, tmp_path):
    store = str(tmp_path / "with space")
    for seq, status in ((1, 1), (2, 2), (2, 2), (3, 1)):
        versions = stored(spark, 30 if seq < 3 else 5).select(
            "gtid", F.lit("1..").alias("context"), F.col("event_time").alias("time"),
            F.lit(status).alias("status"), F.lit(seq).alias("seq"),
        )
        tables.append_tx(versions, store, f"w{status}", str(seq), "UTC")
    columns = ["gtid", "context", "time", "status", "seq", "month"]

    def resolved():
        latest = state.latest_versions(tables.read_tx_versions(spark, store))
        return sorted(map(tuple, latest.select(columns).collect()))

    before = resolved()
    for _ in range(2):
        jobs.merge_versions(spark, store)
        assert resolved() == before and len(before) == 30
        assert tables.read_tx_versions(spark, store).count() == 30
    assert {r.writer for r in tables.read_tx_versions(spark, store).select("writer").collect()} == {"merged"}


def test_retention(spark, tmp_path):
    options = TrailOptions(str(tmp_path), str(tmp_path / "ck"), time_zone="UTC")
    for batch, at in enumerate(["2024-01-01 00:00:00 UTC", "2024-01-31 12:00:00 UTC", "2024-03-01 00:00:00 UTC"]):
        events = stored(spark, 10, at)
        tables.append_events(events, options.store, str(batch), "UTC")
        tables.append_tx(
            events.select("gtid", F.lit("1..").alias("context"), F.col("event_time").alias("time"),
                          F.lit(1).alias("status"), F.lit(batch).alias("seq")),
            options.store, "online", str(batch), "UTC",
        )
    as_of = dt.datetime(2024, 3, 1, 18, tzinfo=UTC)
    kept = jobs.within_retention(
        tables.read_events(spark, options.store), tables.read_tx_versions(spark, options.store), options, as_of
    )
    assert [df.count() for df in kept] == [10, 20]
    assert jobs.drop_expired(spark, options, as_of) == {"day": ["20240101"], "record_day": [], "month": []}
    assert tables.read_events(spark, options.store).count() == 20
    later = dt.datetime(2024, 5, 1, tzinfo=UTC)
    assert jobs.drop_expired(spark, options, later) == {"day": ["20240131", "20240301"], "record_day": [], "month": ["202401"]}
    assert tables.read_tx_versions(spark, options.store).count() == 10


def test_redeliveries_are_kept_once_with_all_parts(spark, tmp_path):
    events = stored(spark, 20).withColumn("gtid", F.lit("g"))
    tx = events.limit(1).select(F.col("event_time").alias("time"), F.lit("1..").alias("context"), "gtid")
    for batch, some in (("online-1", events.where("data < '3'")), ("reconcile-1", events), ("reconcile-2", events)):
        tables.append_audit(records.audit_records(tx, some, max_events=6), str(tmp_path), batch, "UTC")
    kept = records.without_redeliveries(tables.read_audit(spark, str(tmp_path)))
    assert {r.batch for r in kept.collect()} == {"reconcile-2"}
    assert kept.agg(F.sum(F.size("events"))).first()[0] == 20
    assert kept.count() == kept.first().n_parts > 1


def test_ingest_lag(spark):
    events = stored(spark, 3).withColumn(
        "ingest_time", F.col("event_time") + F.make_dt_interval(secs=F.col("data").cast("int") * 20)
    )
    (row,) = reports.ingest_lag(events, 30).collect()
    assert (row.minute, row.max_lag_seconds, row.n_events, row.alert) == ("2024-03-01 12:00", 40, 3, True)


def test_shared_folder_is_the_one_the_session_names(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        pytest.skip("no folder configured")
    assert new_folder(spark, "x").startswith(folder.rstrip("/") + "/x-")


def test_whole_history_looks_for_frequent_notices_before_copies_are_dropped(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "hot_keys", lambda df: seen.append(df.count()) or [])
    tx = spark.sql(
        """SELECT concat('s:', id % 10) AS gtid, '1..' AS context, timestamp'2024-01-01' AS time FROM range(30)"""
    )
    events = spark.sql(
        """SELECT 'd' AS db, 't' AS `table`, 0 AS action, concat('s:', id) AS gtid, 'x' AS data,
        timestamp'2024-01-01' AS time FROM range(5)"""
    )
    jobs.backfill(spark, str(tmp_path), tx, events, seq=1, tz="UTC")
    assert seen == [30]
    assert tables.read_audit(spark, str(tmp_path)).count() == 5
    monkeypatch.setattr(jobs, "hot_keys", lambda df: seen.append(df.count()) or ["s:1"])
    jobs.backfill(spark, str(tmp_path), tx, events, seq=1, tz="UTC", run="hot")
    assert seen == [30, 30, 10]
    assert tables.read_audit(spark, str(tmp_path)).count() == 10


def test_small_files_have_small_id_filters(spark, tmp_path):
    """A filter of a fixed size is 1 MB a file, however few ids are in it."""
    events = spark.range(300).selectExpr(
        "'d' AS db", "'t' AS `table`", "1 AS action", "concat('s:', id) AS gtid", "'{}' AS data",
        "timestamp '2024-03-01 10:00:00 UTC' AS event_time",
        "timestamp '2024-03-01 10:00:00 UTC' + make_interval(0, 0, 0, id % 3) AS ingest_time",
    )
    store = str(tmp_path / "store")
    tables.append_events(events, store, "a", "UTC", merge=True)
    path = tables.event_path(store)
    assert len(tables.close_days(spark, path, ["20240301", "20240302", "20240303"])) == 3
    files = list((tmp_path / "store").rglob("*.parquet"))
    assert len(files) >= 6
    assert max(f.stat().st_size for f in files) < 30_000
    assert tables.read_events(spark, store).where("gtid = 's:77'").count() == 1
