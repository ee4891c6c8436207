"""The provided tables seen as transactions, row changes, topics and snapshots.

Each view is a projection of a whole table; the SQL forms in `oracle.py` use the
same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values used on both sides of the check.
SERVER = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
EPOCH_2024 = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gtid_of(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(f"{SERVER}:"), key.cast("string"))


def epoch(ntz: Column | str) -> Column:
    """Seconds since 1970 of a wall clock taken as UTC, whatever the session zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, F.col(ntz) if isinstance(ntz, str) else ntz)


def clock(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def order_context() -> Column:
    return F.concat_ws(
        ".", F.substring("o_orderpriority", 1, 1), "o_orderstatus", F.col("o_custkey").cast("string")
    )


def tx_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        gtid_of("o_orderkey").alias("gtid"),
        order_context().alias("context"),
        F.col("o_orderdate").alias("time"),
        F.lit(1).alias("status"),
    )


def binlog_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")

    def image(line: Column) -> Column:
        return F.concat(
            F.lit('{"part":'),
            F.col("l_partkey").cast("string"),
            F.lit(',"line":'),
            line.cast("string"),
            F.lit("}"),
        )

    line, none = F.col("l_linenumber"), F.lit("{}")
    before = F.when(flag == "A", none).otherwise(image(line))
    after = F.when(flag == "A", image(line)).when(flag == "N", image(line + 1)).otherwise(none)
    return table(spark, sf_dir, "lineitem").select(
        F.lit("tpch").alias("db"),
        table_name().alias("table"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("action"),
        gtid_of("l_orderkey").alias("gtid"),
        F.concat(F.lit('{"before":'), before, F.lit(',"after":'), after, F.lit("}")).alias("data"),
        F.col("l_shipdate").alias("time"),
    )


def table_name() -> Column:
    return F.when(F.col("l_linestatus") == "O", "line_open").otherwise("line_fill")


def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem as a row change, and every order as an event that is none."""
    flag = F.col("l_returnflag")

    def image(line: Column) -> Column:
        return F.create_map(
            F.lit("part"),
            F.col("l_partkey").cast("string"),
            F.lit("line"),
            line.cast("string"),
            F.lit("note"),
            F.concat(F.lit("<"), F.col("l_linestatus"), F.lit("> & co")),
        )

    none = F.create_map().cast("map<string,string>")
    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("tpch").alias("db"),
        table_name().alias("table"),
        F.when(flag == "A", "insert").when(flag == "N", "update").otherwise("delete")
        .alias("event_type"),
        gtid_of("l_orderkey").alias("gtid_set"),
        epoch("l_shipdate").alias("timestamp"),
        F.when(flag == "A", none).otherwise(image(line)).alias("before"),
        F.when(flag == "A", image(line)).when(flag == "N", image(line + 1)).otherwise(none)
        .alias("after"),
    )
    others = table(spark, sf_dir, "orders").select(
        F.lit("tpch").alias("db"),
        F.lit("orders").alias("table"),
        F.when(F.col("o_orderstatus") == "O", "ddl").otherwise("rotate").alias("event_type"),
        gtid_of("o_orderkey").alias("gtid_set"),
        epoch("o_orderdate").alias("timestamp"),
        none.alias("before"),
        none.alias("after"),
    )
    return rows.unionByName(others)


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they travel: epoch time."""
    return binlog_event(spark, sf_dir).withColumn("time", epoch("time"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as they travel, committed one second after the other."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + EPOCH_2024).alias("time"),
        order_context().alias("context"),
        gtid_of("o_orderkey").alias("gtid"),
    )


def gtid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    kind = key % 6
    gtid = (
        F.when(kind == 0, gtid_of(key))
        .when(kind == 1, F.concat(F.lit(f"{SERVER}:1-"), text))
        .when(kind == 2, F.concat(F.lit("not-a-uuid:"), text))
        .when(kind == 3, F.concat(F.lit(f"{SERVER}:x-"), text))
        .when(kind == 4, F.concat(F.lit(f"{SERVER}:"), text, F.lit("-")))
        .otherwise(F.lit(SERVER))
    )
    return table(spark, sf_dir, "orders").select(key.alias("id"), gtid.alias("gtid"))


def gtid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of three servers with one or two intervals that overlap, touch or leave gaps."""
    key = F.col("o_orderkey")

    def text(number: Column) -> Column:
        return number.cast("string")

    run = (
        F.when(key % 4 == 0, text(3 * key))
        .when(key % 4 == 1, F.concat(text(3 * key), F.lit("-"), text(3 * key + key % 7)))
        .when(key % 4 == 2, F.concat(text(3 * key), F.lit(":"), text(3 * key + 1), F.lit("-"), text(3 * key + 2)))
        .otherwise(F.concat(text(3 * key + 5), F.lit("-"), text(3 * key)))
    )
    # two thirds of all ids are of one server
    server = F.concat(F.lit("server-"), F.greatest(F.lit(0), F.col("o_custkey") % 5 - 2).cast("string"))
    return table(spark, sf_dir, "orders").select(F.concat(server, F.lit(":"), run).alias("gtid"))


def context_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    context = (
        F.when(kind == 0, order_context())
        .when(kind == 1, F.concat(F.col("o_orderstatus"), F.lit(".a.b")))
        .when(kind == 2, F.concat(F.lit("1.a.b."), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("..")))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), context.alias("context")
    )


def user_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as transactions of the user."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == "signup").select(
        gtid_of("user_id").alias("gtid"),
        F.concat(F.lit("1."), F.col("event_id").cast("string"), F.lit(".")).alias("context"),
        F.col("ts").alias("time"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other events as changes by the user."""
    return table(spark, sf_dir, "events").where(F.col("event_type") != "signup").select(
        F.lit("web").alias("db"),
        F.col("event_type").alias("table"),
        F.lit(1).alias("action"),
        gtid_of("user_id").alias("gtid"),
        F.concat(F.lit('{"before":{},"after":'), F.col("props"), F.lit("}")).alias("data"),
        F.col("ts").alias("event_time"),
    )


def event_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an unprocessed transaction of its own."""
    return table(spark, sf_dir, "events").select(
        gtid_of("event_id").alias("gtid"),
        F.concat(F.lit("1."), F.col("event_type"), F.lit(".")).alias("context"),
        F.col("ts").alias("time"),
        F.lit(1).alias("status"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the shape of the example's operational table."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("uuid"),
        F.col("c_name").alias("name"),
        F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
        F.lit(1).alias("status"),
    )


def order_uuid() -> Column:
    """A stable uuid per order, spread like a random one."""
    digest = F.md5(F.col("o_orderkey").cast("string"))
    pieces = [F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)
