import pytest
from pyspark.sql import functions as F

from txtrail.functions import gtid as gt

U = "3e11fa47-71ca-11e1-9e33-c80aa9429562"
PLAIN = U.replace("-", "")

# id, valid, valid when both interval bounds are checked
VECTORS = [
    (f"{U}:5", True, True),
    (f"{U}:1-5", True, True),
    (f"{U}:1-2:7", True, True),
    (f" {U}:5 ", True, True),
    (f"　{U}:5\r\n", True, True),
    (f"{U.upper()}:5", True, True),
    (f"{PLAIN}:5", True, True),
    (f"{{{U}}}:5", True, True),
    (f"{U}:+5", True, True),
    (f"{U}:9223372036854775807", True, True),
    (f"{U}:{'0' * 30}7", True, True),
    (f"{U}:x-5", True, False),
    (f"{U}:-5", True, False),
    (f"{U}:9223372036854775808-5", True, False),
    (U, False, False),
    (f"{U}:", False, False),
    (f"{U}:5-", False, False),
    (f"{U}:5-x", False, False),
    (f"{U}:1-2-3", False, False),
    (f"{U}: 5", False, False),
    (f"{U}:5:", False, False),
    (f"{U}:5\n:6", False, False),
    (f"{U}:9223372036854775808", False, False),
    (f"{{{PLAIN}}}:5", False, False),
    (f"urn:uuid:{U}:5", False, False),
    ("nope:5", False, False),
    (":5", False, False),
    ("", False, False),
    (None, False, False),
]


def test_validity(column):
    ids = [v[0] for v in VECTORS]
    assert column(ids, gt.gtid_valid("c")) == [v[1] for v in VECTORS]
    assert column(ids, gt.gtid_valid("c", gt.STRICT)) == [v[2] for v in VECTORS]


def test_very_many_intervals_are_checked_without_recursion(column):
    many = f"{U}:" + ":".join(f"{n}-{n + 1}" for n in range(50_000))
    assert column([many, many + ":x"], gt.gtid_valid("c")) == [True, False]


def test_unknown_mode_is_rejected(spark):
    with pytest.raises(ValueError, match="gtid mode"):
        gt.gtid_valid("c", "loose")


def test_parts(column):
    ids = [f"{U}:5", f" {U}:1-5:7 ", f"{U}:x-5", U]
    assert column(ids, gt.gtid_uuid("c")) == [U] * 4
    intervals = column(ids, gt.gtid_intervals("c"))
    assert [[tuple(i) for i in row] for row in intervals] == [
        [(5, 5)], [(1, 5), (7, 7)], [(None, 5)], [],
    ]
    assert column(ids, gt.gtid_tx_count("c")) == [1, 6, None, 0]


def test_validity_filter_stays_in_generated_code(spark):
    df = spark.range(10).select(F.concat(F.lit(f"{U}:"), "id").alias("g"))
    plan = df.where(gt.gtid_valid("g"))._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Filter" in plan
