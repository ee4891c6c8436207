import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.sources.bulk_text import is_open, joined_lines, read_bulk_text, write_bulk_text

SCHEMA = T.StructType(
    [T.StructField("id", T.IntegerType(), False), T.StructField("value", T.StringType())]
)


def load(spark, tmp_path, text):
    (tmp_path / "in.txt").write_text(text)
    return read_bulk_text(spark, str(tmp_path / "in.txt"), SCHEMA)


def test_escapes(spark, tmp_path):
    # each escape once: tab, line break, backslash, NUL, control Z, any other, none
    text = "10\tplain\n11\tq\\tr\n12\tq\\nr\n13\t\\\\\n14\t\\0|\\Z\n15\t\\w\\\t\n16\t\\N\n17\t\\\\N\n18\t\n"
    rows = load(spark, tmp_path, text).orderBy("id").collect()
    assert [r.value for r in rows] == ["plain", "q\tr", "q\nr", "\\", "\0|\x1a", "w\t", None, "\\N", ""]
    assert all(r._bad_line is None for r in rows)


def test_bad_lines_are_reported_whole(spark, tmp_path):
    bad = ["1", "1\ta\tb", "x\ta", "\\N\ta", "1\topen\\"]
    rows = load(spark, tmp_path, "\n".join(bad) + "\n").collect()
    assert [r._bad_line for r in rows] == bad


def test_empty_and_missing_files(spark, tmp_path):
    assert load(spark, tmp_path, "").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_bulk_text(spark, str(tmp_path / "nowhere"), SCHEMA)


def test_round_trip(spark, tmp_path):
    values = ["", "\t", "\\", "\\N", "a\\tb", "\n\r\0\b\x1a", None, "é　", "x" * 50_000 + "\\" * 9]
    df = spark.createDataFrame(list(enumerate(values)), SCHEMA)
    write_bulk_text(df, str(tmp_path / "out"))
    rows = read_bulk_text(spark, str(tmp_path / "out"), SCHEMA).orderBy("id").collect()
    assert [r.value for r in rows] == values
    assert all(r._bad_line is None for r in rows)


def test_fields_go_on_in_the_next_line(spark, tmp_path):
    text = "1\ta\\\nb\n2\tc\\\\\n3\t\\\n\\\n\\\\\\\nd\n4\tx\\\n5\ty\n6\tz\n"
    rows = load(spark, tmp_path, text).orderBy("id").collect()
    assert [(r.id, r.value) for r in rows] == [(1, "a\nb"), (2, "c\\"), (3, "\n\n\\\nd"), (4, "x\n5"), (6, "z")]
    # an escaped break does not end the row: the tab behind it opens a third field
    assert [r._bad_line for r in rows] == [None, None, None, "4\tx\\\n5\ty", None]


def whole(lines):
    """The lines of one file put together one by one."""
    out, part = [], []
    for line in lines:
        part.append(line)
        if (len(line) - len(line.rstrip("\\"))) % 2 == 0:
            out.append("\n".join(part))
            part = []
    return out + (["\n".join(part)] if part else [])


@pytest.mark.parametrize("seed", range(4))
def test_lines_over_any_splits(spark, seed):
    """Splits of any size, a line over several of them, files that end in an open escape."""
    rng = random.Random(seed)
    rows, want = [], []
    for file in range(6):
        lines = [f"{file}.{i}" + "\\" * rng.choice([0, 0, 1, 1, 2, 3]) for i in range(rng.randrange(1, 60))]
        want += whole(lines)
        split = 0
        for i, line in enumerate(lines):
            split += 10 if rng.random() < 0.3 else 0
            rows.append((line, f"file{file}", split, i))
    df = spark.createDataFrame(rows, "value string, _file string, _split long, _row long")
    found = joined_lines(df.withColumn("_open", is_open(F.col("value"))))
    assert sorted(r.value for r in found.collect()) == sorted(want)


def test_continued_round_trip_in_many_splits(spark, tmp_path):
    values = [f"{i}\n" * (i % 5) + "\\" * (i % 3) + "\n" * (i % 2) for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(values)), SCHEMA)
    write_bulk_text(df.coalesce(1), str(tmp_path / "out"), continued=True)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_bulk_text(spark, str(tmp_path / "out"), SCHEMA).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.value for r in rows] == values
    assert all(r._bad_line is None for r in rows)
