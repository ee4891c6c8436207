"""Source mixing against water-filling by hand on small tables with awkward rows."""

import hashlib
import math
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from txtrail.llm import mixing


def water_filled(sizes, percent, epochs, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, free = Fraction(sum(sizes.values()) * percent, 100), {}, set(order)
    while free:
        level = (budget - sum(target.values())) / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > epochs * sizes[s]}
        target |= {s: Fraction(epochs * sizes[s]) for s in above}
        free -= above
        if not above:
            target |= {s: weight[s] * level for s in free}
            break
    return target


def rows_of(n=200, seed=4, sources=7):
    rng = random.Random(seed)
    names = [None, "", "É", "a", "b", "zz", "日"][:sources]
    made = [(i, rng.choice(["a"] * 4 + names), "w " * int(rng.paretovariate(0.7))) for i in range(n)]
    return made + [(n, "none", None), (n + 1, "none", " \t "), (0, made[0][1], made[0][2]), (0, "b", "one two"), (None, "a", "x\ny\x0bz"), (n + 2, None, "w " * 20_000)]


@pytest.mark.parametrize("percent, epochs, digits", [(150, 2, 3), (90, 3, 1), (500, 2, 3)])
def test_mixing(spark, percent, epochs, digits):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS key", "2 AS h", "'x' AS size")
    found = mixing.mixed(df, percent=percent, epochs=epochs, digits=digits).collect()
    assert len(found) == len(rows)
    sizes, docs = defaultdict(int), defaultdict(list)
    for i, source, text in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += size
        h = hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()
        docs[source].append((h, i is None, i or 0, size, i))
    target = water_filled(sizes, percent, epochs)
    want = []
    for source, mine in docs.items():
        words = math.floor(target[source])
        whole = words // sizes[source] if sizes[source] else 0
        left = words - whole * sizes[source]
        for _, _, _, size, i in sorted(mine):
            part = max(0, min(size, left))
            left -= size
            want.append((str(i), size, sizes[source], round(float(target[source]), 6), whole * size + part))
    got = [(str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in found]
    assert sorted(got) == sorted(want)
    assert all(r.taken <= epochs * r.size for r in found)


def test_mixing_reruns_agree_and_take_no_rows(spark):
    df = spark.createDataFrame(rows_of(60, 9), "doc_id bigint, source string, text string")
    first, again = (sorted(map(repr, mixing.mixed(d).collect())) for d in (df, df.repartition(7)))
    assert first == again
    assert mixing.mixed(df.limit(0)).collect() == []
    no_words = mixing.mixed(df.where("source = 'none'")).collect()
    assert [(r.size, r.target, r.taken) for r in no_words] == [(0, 0.0, 0)] * 2
