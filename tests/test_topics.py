import base64
import json

import pytest

from txtrail.operators import filters
from txtrail.operators.projections import new_tx, to_stored_event, to_stored_tx
from txtrail.options import TopicOptions, TrailOptions
from txtrail.sources import topics
from pyspark.sql import functions as F


def messages(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_event_round_trip(spark):
    data = '{"before":{},"after":{"name":"é<&"}}'
    df = spark.createDataFrame(
        [("d", "t", 1, "g", 7, data)], "db string, `table` string, action int, gtid string, time bigint, data string"
    )
    (message,) = [r.value for r in topics.encode_events(df).collect()]
    assert json.loads(message) == {
        "db": "d", "table": "t", "action": 1, "gtid": "g", "time": 7,
        "data": base64.b64encode(data.encode()).decode(),
    }
    (row,) = topics.good_rows(topics.decode_events(messages(spark, message))).collect()
    assert row.asDict() == {"db": "d", "table": "t", "action": 1, "gtid": "g", "time": 7, "data": data}


def test_missing_and_null_fields_take_zero_values(spark):
    rows = topics.good_rows(topics.decode_events(messages(spark, "{}", '{"db":null,"extra":{"x":[1]}}')))
    assert [tuple(r) for r in rows.collect()] == [("", "", 0, "", 0, "")] * 2
    (tx,) = topics.good_rows(topics.decode_tx(messages(spark, '{"gtid":"g"}'))).collect()
    assert tuple(tx) == (0, "", "g")


@pytest.mark.parametrize("bad", [
    "", "x", "[1]", '[{"db":"d"}]', '{"db":"d"', '{"action":"insert"}', '{"data":"***"}',
    '{"time":1.5}', '"text"', None,
])
def test_bad_messages_are_quarantined_whole(spark, bad):
    decoded = topics.decode_events(messages(spark, bad))
    assert topics.good_rows(decoded).count() == 0
    assert [r.value for r in topics.quarantine(decoded).collect()] == [bad or ""]


def test_golden_envelopes_to_stored_rows(spark):
    event = {"db": "testdb01", "table": "user", "action": 0, "gtid": "g:248", "time": 1675949679,
             "data": base64.b64encode(b'{"before":{},"after":{}}').decode()}
    stored = to_stored_event(
        topics.good_rows(topics.decode_events(messages(spark, json.dumps(event)))),
        F.timestamp_seconds(F.lit(1675949700)),
    )
    (row,) = stored.select("*", F.unix_timestamp("event_time").alias("e")).collect()
    assert (row.data, row.e) == ('{"before":{},"after":{}}', 1675949679)
    notice = {"time": 1675949679, "context": "1.a.b", "gtid": "g:248"}
    tx = to_stored_tx(topics.good_rows(topics.decode_tx(messages(spark, json.dumps(notice)))), 2)
    (row,) = tx.select("*", F.unix_timestamp("time").alias("e")).collect()
    assert (row.gtid, row.context, row.status, row.e) == ("g:248", "1.a.b", 2, 1675949679)
    assert row.seq > 1_700_000_000_000_000


def test_new_notice(spark):
    as_of = F.timestamp_seconds(F.lit(5))
    (row,) = new_tx(spark.range(1), F.lit("1.a.b"), F.lit("g"), as_of).collect()
    assert tuple(row) == (5, "1.a.b", "g")


def test_start_position():
    assert topics.start_position(TopicOptions()) == {"startingOffsets": "latest"}
    assert topics.start_position(TopicOptions(use_oldest=True)) == {"startingOffsets": "earliest"}
    explicit = TopicOptions(offsets={"binlog": {"0": 23}}, use_oldest=True)
    assert json.loads(topics.start_position(explicit)["startingOffsets"]) == {"binlog": {"0": 23}}


def test_unknown_options_are_rejected():
    with pytest.raises(TypeError):
        TrailOptions("s", "c", use_oldest_offest=True)
    with pytest.raises(ValueError, match="completeness"):
        TrailOptions("s", "c", completeness="maybe")


def test_include_list(spark):
    rows = [("d", "a"), ("d", "A"), ("D", "a"), ("d", "b"), ("e", "a")]
    df = spark.createDataFrame(rows, "db string, `table` string")
    kept = filters.included_tables(df, ["d.a", "e.a.ignored", "x.y"])
    assert sorted(map(tuple, kept.collect())) == [("d", "a"), ("e", "a")]
    assert filters.included_tables(df, []).count() == 0
    with pytest.raises(ValueError, match="db.table"):
        filters.included_tables(df, ["nodot"])


def test_long_include_list_is_a_join_with_the_same_result(spark):
    df = spark.createDataFrame([("d", "t7"), ("d", "t"), ("e", "t7")], "db string, `table` string")
    kept = filters.included_tables(df, [f"d.t{n}" for n in range(filters.MAX_INLINE_TABLES + 1)])
    assert [tuple(r) for r in kept.collect()] == [("d", "t7")]


def test_offsets_are_refused_where_nothing_has_them(spark, tmp_path):
    topic = TopicOptions("text", {"path": str(tmp_path)}, offsets={"binlog": {"0": 23}})
    with pytest.raises(ValueError, match="no offsets"):
        topics.read_topic(spark, topic)
