import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.functions import payload as pl
from txtrail.operators.projections import raw_to_event


def test_action_names_and_codes(column):
    names = column([0, 1, 2, 7, -1], pl.action_name("c"), "int")
    assert names == ["insert", "update", "delete", "unknown", "unknown"]
    assert column(["insert", "update", "delete", "ddl"], pl.action_code("c")) == [0, 1, 2, 0]


def test_payload_text_has_sorted_keys_and_escapes(spark):
    df = spark.createDataFrame(
        [({}, {"name": "<b>& ", "email": "x", "none": None}), (None, None)],
        "before map<string,string>, after map<string,string>",
    )
    texts = [r.p for r in df.select(pl.payload_json(F.col("before"), F.col("after")).alias("p")).collect()]
    assert texts[0] == (
        '{"before":{},"after":{"email":"x","name":"\\u003cb\\u003e\\u0026\\u2028","none":null}}'
    )
    assert texts[1] == '{"before":{},"after":{}}'


def test_payload_from_variant_keeps_types(spark):
    df = spark.sql(
        """SELECT 'd' AS db, 't' AS `table`, 'insert' AS event_type, 'g' AS gtid_set,
                  7L AS timestamp, parse_json('{}') AS before,
                  parse_json('{"z":1,"a":"1","n":null,"f":1.5}') AS after"""
    )
    (row,) = raw_to_event(df).collect()
    assert row.data == '{"before":{},"after":{"a":"1","f":1.5,"n":null,"z":1}}'
    assert (row.db, row.table, row.action, row.gtid, row.time) == ("d", "t", 0, "g", 7)


def test_payload_from_struct_keeps_nulls(spark):
    df = spark.sql("SELECT struct(1 AS a, CAST(NULL AS STRING) AS b) AS s, NULL AS n")
    text = df.select(pl.payload_json(F.col("n"), F.col("s"), map_columns=False).alias("p")).first().p
    assert text == '{"before":{},"after":{"a":1,"b":null}}'


def test_field_access(column):
    data = ['{"before":{},"after":{"a.b":"x","n":5}}']
    assert column(data, pl.payload_field("c", "after", "a.b")) == ["x"]
    assert column(data, pl.payload_field("c", "after", "n")) == ["5"]
    assert column(data, pl.payload_field("c", "before", "n")) == [None]
    with pytest.raises(ValueError):
        pl.payload_field("c", "during", "n")


C = pl.SourceColumn


def bounds(type_, bits):
    """Lowest and highest whole number of a type, signed and not."""
    return [
        (C(f"{type_.lower()}_s", type_), [str(-(1 << bits - 1)), str((1 << bits - 1) - 1), None],
         [-(1 << bits - 1), (1 << bits - 1) - 1, None]),
        (C(f"{type_.lower()}_u", type_, unsigned=True), ["0", str((1 << bits) - 1), None],
         [0, (1 << bits) - 1, None]),
    ]


# column, texts of three rows, values of three rows
MATRIX = [
    *bounds("TINYINT", 8), *bounds("SMALLINT", 16), *bounds("MEDIUMINT", 24), *bounds("INT", 32),
    (C("big_s", "BIGINT"), [str(-(1 << 63)), str((1 << 63) - 1), None], [-(1 << 63), (1 << 63) - 1, None]),
    (C("big_u", "BIGINT", unsigned=True), ["0", str((1 << 64) - 1), None], [Decimal(0), Decimal((1 << 64) - 1), None]),
    (C("single", "FLOAT"), ["-0.5", "1e3", None], [-0.5, 1000.0, None]),
    (C("twice", "DOUBLE"), ["0.1", "-2e-3", "x"], [0.1, -0.002, None]),
    (C("money", "DECIMAL", precision=9, scale=2), ["7.005", "-9999999.99", None],
     [Decimal("7.01"), Decimal("-9999999.99"), None]),
    (C("short", "CHAR"), ["", " é ", None], ["", " é ", None]),
    (C("long", "LONGTEXT"), ["0", "q" * 300, None], ["0", "q" * 300, None]),
    (C("raw", "VARBINARY"), ["", "/wA=", None], [b"", b"\xff\x00", None]),
    # fixed value: the zero date stands for the first of January of year one
    (C("moment", "DATETIME"), ["1999-12-31 23:59:59.999999", "0000-00-00 00:00:00", None],
     [dt.datetime(1999, 12, 31, 23, 59, 59, 999999), dt.datetime(1, 1, 1), None]),
    (C("day", "DATE"), ["2024-02-29", "1970-01-01", None], [dt.date(2024, 2, 29), dt.date(1970, 1, 1), None]),
    # fixed value: the lowest time of the type
    (C("span", "TIME"), ["-838:59:59", "01:02:03.5", None], [-3_020_399_000_000, 3_723_500_000, None]),
    (C("year", "YEAR"), ["1901", "2155", None], [1901, 2155, None]),
]


def test_typed_columns(spark):
    rows = [
        (json.dumps({"before": {}, "after": {c.name: texts[i] for c, texts, _ in MATRIX}}),)
        for i in range(3)
    ]
    typed = pl.with_typed(spark.createDataFrame(rows, "data string"), [c for c, _, _ in MATRIX])
    assert typed.select("after.*").schema.fieldNames() == [c.name for c, _, _ in MATRIX]
    got = typed.collect()
    assert [r.before for r in got] == [None] * 3
    for column, _, values in MATRIX:
        found = [r.after[column.name] for r in got]
        found = [bytes(v) if isinstance(v, bytearray) else v for v in found]
        assert found == values, column


def test_schema_from_metadata():
    schema = pl.payload_schema([C("id", "BIGINT", unsigned=True, nullable=False), C("t", "TIME")])
    assert schema == T.StructType(
        [T.StructField("id", T.DecimalType(20, 0), False), T.StructField("t", T.LongType())]
    )
    with pytest.raises(ValueError, match="unknown column type"):
        pl.payload_schema([C("x", "WAT")])


def test_filters_do_not_repeat_the_parse(spark):
    df = spark.createDataFrame([('{"after":{"a":"1"}}',)], "data string")
    filtered = pl.with_fields(df, "after", ["a"]).where(F.col("after_a") == "1")
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert filtered.count() == 1
