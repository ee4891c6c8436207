import random

from txtrail.operators import gtid_sets


def covered(rows):
    return {(s, n) for s, lo, hi in rows for n in range(lo, hi + 1)}


def test_sets_against_single_numbers(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        server, lo = rng.choice("aaab"), rng.randrange(0, 900)
        rows.append((server, lo, lo + rng.choice([0, 0, 1, 5])))
    rows += [("a", 100, 160), ("c", 7, 7)] + rows[:20]
    df = spark.createDataFrame([(f"{s}:{lo}-{hi}",) for s, lo, hi in rows], "gtid string").repartition(5)
    found = sorted(map(tuple, gtid_sets.executed_set(df).collect()))
    assert covered(found) == covered(rows)
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(found, found[1:]))
    gaps = [tuple(r) for r in gtid_sets.missing_ranges(df).collect()]
    for server in "abc":
        own = [n for s, n in covered(rows) if s == server]
        assert {n for s, n in covered(gaps) if s == server} == set(range(min(own), max(own) + 1)) - set(own)
    halves = [gtid_sets.executed_set(df.where(f"crc32(CAST(gtid AS BINARY)) % 2 = {n}")) for n in range(2)]
    assert sorted(map(tuple, gtid_sets.united(*halves).collect())) == found


def test_intervals_that_hold_nothing(spark):
    top = 2**63 - 1
    ids = ["s:5:7-6", "s:x-9", "s", None, "s:-3", f"s:6-{top}", "s:0:1"]
    df = spark.createDataFrame([(i,) for i in ids], "gtid string")
    assert sorted(map(tuple, gtid_sets.executed_set(df).collect())) == [("s", 0, 1), ("s", 5, top)]
    assert [tuple(r) for r in gtid_sets.missing_ranges(df).collect()] == [("s", 2, 4)]
    assert gtid_sets.executed_set(df.limit(0)).collect() == []
