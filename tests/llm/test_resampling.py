"""Importance resampling against one CRC for each n-gram on small tables with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from txtrail.llm import resampling

WORDS = "stone river Lamp north paper glass wind salt éclat 日本 42".split()


def texts(n=60, seed=5):
    rng = random.Random(seed)
    made = [(i, rng.choice(["", " ", "--"]) + rng.choice([" ", "\n\t", ", "]).join(rng.choice(WORDS) for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    return made + [(n, None), (n + 1, ""), (n + 2, "...!"), (n + 3, "x" * 70_000 + " river"), (0, made[0][1]), (1, "other " * 30), (None, "salt " * 25)]


def ngrams(text, longest):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest, buckets, least, percent, seed):
    def bucket(gram):
        return zlib.crc32(gram.encode()) % buckets

    grams = [(i, *ngrams(t, longest)) for i, t in docs]
    s = Counter(bucket(g) for _, _, found in grams for g in found)
    t = Counter(bucket(g) for text in target for g in ngrams(text, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in s}
    rows = []
    for i, words, found in grams:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, len(found), weight, score, len(words) >= least))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0], -r[1], -r[2]))
    drawn = len(fit) * percent // 100
    ranked = [(*r[:4], n + 1 if n < drawn else None) for n, r in enumerate(fit)]
    return ranked + [(*r[:4], None) for r in rows if not r[4]]


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 37, 40)])
def test_resampling(spark, documents, longest, buckets, percent):
    docs = texts()
    target = ["lamp north stone", None, "", "River, glass 42 日本 日本"]
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    found = resampling.resampled(documents(docs), wanted, percent, longest, buckets)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute(docs, target, longest, buckets, 20, percent, 2024)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, want))


def test_crcs_of_ngrams_from_prefixes():
    text = "  a bc, déf 日本 " + "q" * 5000 + " z"
    data = np.frombuffer(text.encode() * 2, np.uint8)
    scan = resampling.Scan(data, np.array([0, len(data) // 2, len(data)]))
    words, _ = ngrams(text, 1)
    for n in range(1, 5):
        doc, crcs = scan.ngrams(n)
        want = [zlib.crc32(" ".join(words[i : i + n]).encode()) for i in range(len(words) - n + 1)]
        assert crcs.tolist() == want * 2
        assert doc.tolist() == [0] * len(want) + [1] * len(want)


def test_resampling_of_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert resampling.resampled(documents([]), none).collect() == []
    found = resampling.resampled(documents([(1, "salt " * 20), (2, None)]), none, percent=100).collect()
    assert sorted((r.doc_id, r.rank) for r in found) == [(1, 1), (2, None)]
