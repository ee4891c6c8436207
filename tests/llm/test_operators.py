"""Operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txtrail.llm import bpe, langid, maxscore, packing, quality, recipes, repeats, simhash, toxicity, urlrules
from txtrail.llm.catalog import LANGUAGE_PIECES, TOKENIZER, URL_RULES
from txtrail.llm.common import marked_by

PATH = public_tokenizers.path(TOKENIZER)
WORDS = "stone river lamp north paper glass wind salt ember field".split()


def texts(n=60, seed=3):
    rng = random.Random(seed)
    made = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    copies = [(n + i, made[rng.randrange(n)][1].replace(" ", "\n\t", i % 3)) for i in range(20)]
    long = [(n + 20, "lamp " * 3000), (n + 21, "x" * 9000)]
    return made + copies + long + [(n + 30, None), (n + 31, ""), (n + 32, " \t "), (n + 33, "é日😀<|endoftext|> a"), (0, made[0][1]), (None, "salt")]


def reachable(values, linked):
    root = {i: i for i in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in values:
        for j in values:
            if j < i and linked(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in values}


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("hot_pairs", [simhash.HOT_PAIRS, 2])
def test_simhash_components(documents, hot_pairs):
    rows = texts()
    found = simhash.near_components(documents(rows), hot_pairs=hot_pairs, block=4).collect()
    prints = {i: fingerprint(t) for i, t in rows if i is not None}
    want = reachable(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == prints[r.doc_id]
            assert r.component_id == want[r.doc_id]


def test_golay_keys_meet_at_two_errors():
    code = simhash.Golay.get()
    words = np.random.default_rng(1).integers(0, 1 << 23, 200, dtype=np.uint32)
    near = lambda w: [set(i[ok]) for i, ok in zip(*code.near(w))]
    own = near(words)
    for a in range(23):
        for b in range(a + 1):
            other = near(words ^ np.uint32(1 << a | 1 << b))
            assert all(x & y for x, y in zip(own, other))


def test_similar_documents_keep_the_first(documents):
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    near = base[:90] + ["changed"] + base[91:]
    other = [f"v{rng.randrange(500)}" for _ in range(200)]
    rows = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(other)), (None, " ".join(base)), (7, None)]
    kept = simhash.without_near_duplicates(documents(rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 7, 9, None]


def five_word_counts(text):
    words = (text or "").split()
    return Counter(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def cosine(x, y):
    return sum(n * y[s] for s, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()) or 1)


def versions(n, seed, changes):
    """Pairs of random texts and versions of them: words changed, a passage appended or cut off."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 20_000}"
    for i in range(n):
        base = [word() for _ in range(rng.randrange(100, 400))]
        kind, share = changes[i % len(changes)]
        other = list(base)
        if kind == "edit":
            for at in rng.sample(range(len(base)), int(len(base) * share)):
                other[at] = word()
        elif kind == "append":
            other += [word() for _ in range(int(len(base) * share))]
        else:
            other = base[: int(len(base) * (1 - share))]
        yield " ".join(base), " ".join(other)


def test_similar_pairs_are_verified(documents):
    made = list(versions(240, 21, [("edit", 0.01 * k / 2) for k in range(4, 16)]))
    of = [cosine(*map(five_word_counts, pair)) for pair in made]
    assert sum(0.7 < c < 0.8 for c in of) > 30 and sum(0.8 <= c < 0.9 for c in of) > 30
    rows = [(2 * i + k, text) for i, pair in enumerate(made) for k, text in enumerate(pair)]
    found = {r.doc_id: r.component_id for r in simhash.similar_components(documents(rows)).collect()}
    linked = [found[2 * i + 1] == 2 * i for i in range(len(made))]
    assert all(found[2 * i] == 2 * i for i in range(len(made)))
    assert not [c for c, joined in zip(of, linked) if joined and c < 0.8]
    missed = [c for c, joined in zip(of, linked) if not joined and c >= 0.8]
    assert len(missed) <= 0.1 * sum(c >= 0.8 for c in of)


@pytest.mark.parametrize("kind", ["append", "cut", "edit"])
def test_similar_pairs_are_found(documents, kind):
    shares = {"append": (0.1, 0.5), "cut": (0.1, 0.35), "edit": (0.01, 0.03)}[kind]
    made = list(versions(200, 31, [(kind, shares[0] + (shares[1] - shares[0]) * k / 9) for k in range(10)]))
    of = [cosine(*map(five_word_counts, pair)) for pair in made]
    rows = [(2 * i + k, text) for i, pair in enumerate(made) for k, text in enumerate(pair)]
    found = {r.doc_id: r.component_id for r in simhash.similar_components(documents(rows)).collect()}
    alike = [i for i, c in enumerate(of) if c >= 0.8]
    assert len(alike) > 150
    assert sum(found[2 * i + 1] == 2 * i for i in alike) >= 0.99 * len(alike)


@pytest.mark.parametrize("small", [{}, {"hot_rows": 5, "block_shingles": 900, "block_texts": 4}])
def test_a_dense_group_below_the_similarity_lists_no_pairs(documents, monkeypatch, small):
    rng = random.Random(11)
    shared = [f"w{rng.randrange(900)}" for _ in range(70)]
    rows = []
    for i in range(0, 80, 2):
        words = shared + [f"w{rng.randrange(900)}" for _ in range(38)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:-3] + ["x"] * 3))]
    counts = [five_word_counts(text) for _, text in rows]
    close = {(a, b) for a in range(80) for b in range(a + 1, 80) if cosine(counts[a], counts[b]) >= 0.8}
    assert close == {(a, a + 1) for a in range(0, 80, 2)}
    listed, verified = [], simhash.verified

    def counted(docs, pairs, *args):
        listed.append(pairs.count())
        return verified(docs, pairs, *args)

    monkeypatch.setattr(simhash, "verified", counted)
    found = {r.doc_id: r.component_id for r in simhash.similar_components(documents(rows), **small).collect()}
    assert found == {i: i - i % 2 for i in range(80)}
    assert sum(listed) < 800  # there are 3120 pairs of different components


def test_rows_with_candidates_come_once_each(documents):
    spark = documents([]).sparkSession
    sides = [(k, 10 * k + v, 0 if v < 8 else 255, 0, 0, 0, v // 2) for k in range(3) for v in range(10)]
    rows = spark.createDataFrame(sides + [(9, v, 0, 0, 0, 0, 1) for v in range(6)], "key long, v long, s0 long, s1 long, s2 long, s3 long, c long")
    expected = [(k, 10 * k + v) for k in range(3) for v in range(8)]
    for hot_rows in (3, 7, 100):
        found = simhash.with_candidates(rows, rows.select("key", "c"), 4, hot_rows)
        assert sorted(tuple(r) for r in found.collect()) == expected


def test_edges_within_a_block_connect_what_its_pairs_connect():
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        kept = rng.random(40) < 0.88
        own = rng.integers(1000, 10**6, rng.integers(0, 4))
        distinct = np.unique(np.concatenate([np.arange(40)[kept], own])).astype(np.uint64)
        texts.append((distinct, rng.integers(1, 4, len(distinct))))
    texts.append((np.empty(0, np.uint64), np.empty(0, np.int64)))
    vectors = [Counter(dict(zip(d.tolist(), c.tolist()))) for d, c in texts]
    alike = {(a, b) for a in range(61) for b in range(a) if cosine(vectors[a], vectors[b]) >= 0.85}
    sides = np.arange(61) % 2

    def classes(pairs):
        low = list(range(61))
        for _ in low:
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        return low

    for step in (7, simhash.STEP_SHARED):
        simhash.STEP_SHARED, before = step, simhash.STEP_SHARED
        try:
            found = simhash.similar_in_block(texts, np.arange(61), None, 0.85)
            across = simhash.similar_in_block(texts, np.arange(61), sides, 0.85)
            none = simhash.similar_in_block(texts, np.zeros(61, np.int64), None, 0.85)
        finally:
            simhash.STEP_SHARED = before
        assert {(max(p), min(p)) for p in found} <= alike and len(found) < 61 and none == []
        assert 1 < len(set(classes(alike))) < 61 and classes(found) == classes(alike)
        assert classes(across) == classes([p for p in alike if sides[p[0]] != sides[p[1]]])


def test_pairs_of_one_text_are_dealt_out_to_several_groups(documents, monkeypatch):
    monkeypatch.setattr(simhash, "HUB_PAIRS", 3)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[: 60 - i] + ["x"] * i)) for i in range(1, 25)] + [(25, None)]
    docs = documents(rows + [(4, "another text under the same id")])
    known = simhash.wide_fingerprints(docs, 5).select(F.col("doc_id").alias("v"), "g").collect()
    pairs = [(0, k.g, o.v, o.g) for k in known if k.v == 0 for o in known if o.v]
    found = simhash.verified(docs, docs.sparkSession.createDataFrame(pairs, "xv long, xg long, yv long, yg long"), 5, 0.8)
    counts = [five_word_counts(text) for _, text in rows]
    expected = {(0, i) for i in range(1, 26) if cosine(counts[0], counts[i]) >= 0.8 - 1e-9}
    assert 3 < len(expected) < 24 and {tuple(r) for r in found.collect()} == expected


def test_rows_without_a_mark_have_none_of_the_ids(documents):
    docs = documents([(i, "x") for i in range(2000)] + [(None, "y")])
    ids = docs.where("doc_id % 100 = 7").select("doc_id")
    marked = marked_by(docs, ids, "doc_id")
    assert marked.count() == 2001 and marked.columns == [*docs.columns, "_marked"]
    assert marked.where("_marked and doc_id % 100 = 7").count() == 20
    assert marked.where("_marked").count() < 400
    assert marked_by(docs, ids.where("false"), "doc_id").where("_marked").isEmpty()


def test_similarity_of_just_the_threshold_and_rows_that_repeat(documents):
    one, four = "a b c d e", "a b c d e f g h i"  # four: five shingles, one of them that of `one`
    nine = "a b c d e f g h x"  # four of these five are those of `four`
    rows = [(1, four), (2, nine), (2, nine), (1, one), (5, None), (4, " "), (3, "A  b c d e f g h i")]
    found = {(r.doc_id, r.component_id) for r in simhash.similar_components(documents(rows)).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)}


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_recipes(documents, id_bytes):
    rows = texts() + [(500, "a" * 40_000 + "b"), (501, "a" * 40_000 + "c"), (502, "a" * 40_000 + "b")]
    found = recipes.exact_duplicates(documents(rows), id_bytes).collect()
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    assert len(found) == len(rows)
    for r in found:
        of = {t for i, t in plain if i == r.doc_id}
        text = next(t for t in of if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i, t in plain if t == text]
        keep = min(i for i in ids if i is not None) if any(i is not None for i in ids) else None
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_kept_rows_are_one_for_each_text(documents):
    rows = texts()
    kept = recipes.without_duplicates(documents(rows)).collect()
    plain = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows}
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept) == sorted(plain)


def test_repeats_where_stretches_meet(documents):
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300_000))
    begins = range(repeats.STRETCH - 150, repeats.STRETCH + 50)
    later = [(10 + i, long[b : b + 100]) for i, b in enumerate(begins)]
    earlier = [(i + 1, "".join(rng.choices("0123456789", k=50)) + long[b : b + 100]) for i, b in enumerate(begins[::100])]
    found = {r.doc_id: r.n_removed for r in repeats.without_repeats(documents([*earlier, (5, long), *later])).collect()}
    assert found == {1: 0, 2: 0, 5: 200} | {i: 100 for i, _ in later}


@pytest.mark.parametrize("options", [{}, {"hot_anchors": 3}])
def test_repeats_in_small_stretches(documents, options):
    rng = random.Random(14)
    whole = "".join(rng.choices("abcd", k=600))
    rows = [(0, whole)] + [(1 + i, "-" * (i % 3) + whole[b : b + 24 + i % 30] + str(i)) for i, b in enumerate(range(0, 570, 3))]
    least, seen, want = 24, set(), {}
    for i, text in rows:
        covered = bytearray(len(text))
        for s in range(len(text) - least + 1):
            if text[s : s + least] in seen:
                covered[s : s + least] = b"\1" * least
            seen.add(text[s : s + least])
        want[i] = "".join(x for x, c in zip(text, covered) if not c)
    found = repeats.without_repeats(documents(rows), least, gram=8, stretch=40, **options).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in found} == want


@pytest.mark.parametrize("options", [{}, {"hot_anchors": 3}, {"held": 40}])
def test_repeats(documents, options):
    rows = [(i, t) for i, t in texts() if i is not None]
    least, seen, want = 24, set(), {}
    for i, t in sorted({(i, t or "") for i, t in rows}):
        data = t.encode()
        covered = bytearray(len(data))
        for s in range(len(data) - least + 1):
            if data[s : s + least] in seen:
                covered[s : s + least] = b"\1" * least
            seen.add(data[s : s + least])
        runs = len(re.findall(rb"\x01+", bytes(covered)))
        want[i] = (len(data), sum(covered), runs, bytes(x for x, c in zip(data, covered) if not c))
    found = repeats.without_repeats(documents(rows), least, gram=8, **options).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]


def test_intervals_of_a_small_tree():
    assert sorted(repeats.intervals([3, 1, 2, 2], 1)) == [(0, 1, 3), (0, 4, 1), (2, 4, 2)]


def test_codec_is_the_tokenizers(documents):
    own, public = bpe.Codec.at(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(4)
    letters = [*" \n\t\r  \x1c\x85'stdlver aAB1²é日😀!?.<|>", "<|endoftext|>", " the", "'ll"]
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for text in [*made, "ab" * 600, "q" * 1500]:
        ids = public.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids == packing.FastCodec.at(PATH).encode(text).tolist()
        assert own.decode(np.array(ids, int)) == public.decode(ids, skip_special_tokens=False)


def test_codec_round_trip(documents):
    df = documents(texts())
    assert {(r.doc_id, r.text) for r in bpe.decoded(bpe.encoded(df, PATH), PATH).collect()} == {(i, t or "") for i, t in texts()}


def test_packing_is_gapless_and_tight(documents):
    rows = texts(300)
    found = packing.packed(documents(rows), PATH, capacity=64, district=100).collect()
    tokens = sum(len(bpe.Codec.at(PATH).encode(t or "")) + 1 for _, t in rows)
    assert sum(r.length for r in found) == tokens
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in bins.values():
        end = 0
        for offset, length in sorted(members):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= tokens / 64 * 1.05 + 4


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 200).tolist()
    a, b = packing.first_population(sizes, 64, 2, rng)[:1] * 2
    child = packing.crossover(a, b, sizes, 64, rng)
    assert sorted(i for members in child for i in members) == list(range(200))
    assert all(sum(sizes[i] for i in members) <= 64 for members in child)


@pytest.mark.parametrize("shard", [7, 8192])
def test_search(spark, shard):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).astype("f4").tolist()) for i in range(90)] + [(200, None), (201, [1.0] * 7 + [None]), (202, [float("nan")] * 8)]
    rows += [(300 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("q", F.lit("clash"))
    found = maxscore.search(df, F.col("vec_id") % 20 == 0, k=5, query_block=3, shard=shard).collect()
    whole = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in rows if i < 200 or i >= 300}
    want = set()
    for i in [i for i in whole if i % 20 == 0]:
        best = sorted((-int(whole[i] @ whole[j]), j) for j in whole if j != i)[:5]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    assert {tuple(r) for r in found} == want


def best_of_equal_length(rows, every, k):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = set()
    for i, q in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i and len(v) == len(q))[:k]
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return want


@pytest.mark.parametrize("scale", [1.0, 2.0**25, 2.0**22])
def test_maxscore_lengths_and_large_components(spark, scale):
    rng = random.Random(8)
    rows = [(i, [scale * rng.uniform(-1, 1) for _ in range([2, 1, 0, 5][i % 4])]) for i in range(60)]
    rows += [(100, [2.0**26, 0.0, -1.0, 0.0, 0.0]), (104, [0.0] * 5), (108, [0.5 + n for n in range(7)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = maxscore.search(df, F.col("vec_id") % 4 == 0, k=3, query_block=4, shard=6).collect()
    assert {tuple(r) for r in found} == best_of_equal_length(rows, 4, 3)
    assert len(found) == len({tuple(r) for r in found})


def test_maxscore_touches_few_vectors_of_sparse_lists(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(0.2, 1) if rng.random() < 0.1 else 0.0 for _ in range(40)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = maxscore.search(df, F.col("vec_id") % 5 == 0, k=3).collect()
    assert {tuple(r) for r in found} == best_of_equal_length(rows, 5, 3)


def test_maxscore_refuses_what_64_bits_cannot_hold(spark):
    schema = "vec_id bigint, embedding array<double>"
    with pytest.raises(ValueError, match="too large"):
        maxscore.search(spark.createDataFrame([(1, [2.0**57])], schema), F.lit(True))
    with pytest.raises(PythonException, match="too large"):
        maxscore.search(spark.createDataFrame([(1, [2.0**30]), (2, [2.0**30])], schema), F.lit(True)).collect()


def test_url_rules(spark):
    urls = ["http://A.net/x", "http://example.net/en/1", "http://www.example.com/de/9?x", "https://b.org/fr/#q", "nothing", None, "http://net", "http://xnet/"]
    urls += [f"http://h{i % 7}.net/bad/{i}" for i in range(40)] + [f"http://h{i % 7}.org/fr/{i}" for i in range(40)]
    urls += ["http://z.info/bad/1", "http://z.info/ok/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("key", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judged(pages, URL_RULES, max_tokens=2).collect()}
    assert len(got) == len(urls)
    assert got[0] == ("a.net", "/x", "net/", "block")
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block")
    assert got[3] == ("b.org", "/fr/", "org/fr/", "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][1:3] == ("", None) and got[7][2] is None
    assert got[len(urls) - 2][3] == "block" and got[len(urls) - 1][3] == "allow"


def mined_by_enumeration(labelled, urls, least, confidence, most):
    """Verdict of each token set: all token sets of a labelled row are tried as rules."""
    hits = Counter(
        (frozenset(part), verdict)
        for tokens, verdict in labelled
        for n in range(1, most + 1)
        for part in itertools.combinations(sorted(tokens), n)
    )
    sets = Counter()
    for (part, _), n in hits.items():
        sets[part] += n
    rules = {k: n / sets[k[0]] for k, n in hits.items() if n >= least and n / sets[k[0]] >= confidence}
    kept = {k for k, c in rules.items() if not any(v == k[1] and p < k[0] and d >= c for (p, v), d in rules.items())}
    best = lambda u: max(((rules[k], hits[k], k[1]) for k in kept if k[0] <= u), default=(0, 0, "allow"))[2]
    return [best(u) for u in urls]


@pytest.mark.parametrize("broadcast", [urlrules.BROADCAST_ROWS, 0])
def test_mined_verdicts_by_enumeration(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urlrules, "BROADCAST_ROWS", broadcast)
    rng = random.Random(12)
    words = "ad shop news blog cart wiki".split()
    paths = ["/".join(rng.sample(words, rng.randrange(1, 5))) for _ in range(240)]
    hosts = [rng.choice(["a.net", "b.net", "x.org/fr", "x.info", "y.info", "z.biz"]) for _ in paths]
    urls = [f"http://{h}/{p}" for h, p in zip(hosts, paths)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.judged(pages, URL_RULES, 0.05, 0.6, 3, 4).collect()}
    sets = [frozenset(re.split(r"[./]", u[7:])) for u in urls]
    labelled = [(t, got[i][1]) for i, t in enumerate(sets) if got[i][0]]
    rest = [i for i in range(len(urls)) if not got[i][0]]
    want = mined_by_enumeration(labelled, [sets[i] for i in rest], max(4, math.ceil(0.05 * len(labelled))), 0.6, 3)
    assert [got[i][1] for i in rest] == want
    assert len(set(want)) == 2


def test_many_shared_tokens_are_mined_in_time(spark):
    """Twenty words in every blocked path, and as many in nearly every path of either verdict."""
    always, mostly = [f"a{chr(97 + i)}" for i in range(20)], [f"m{chr(97 + i)}" for i in range(8)]
    urls = [f"http://h.net/{'/'.join(always + mostly)}/{i}" for i in range(60)]
    urls += [f"http://h.org/fr/{'/'.join(w for j, w in enumerate(mostly) if (i + j) % 9)}" for i in range(60)]
    urls += [f"http://h.info/{'/'.join(always)}", "http://h.info/fr"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    start = time.monotonic()
    got = {r.page_id: r.verdict for r in urlrules.judged(pages, URL_RULES).collect()}
    assert (got[120], got[121]) == ("block", "allow")
    assert time.monotonic() - start < 60


def test_path_is_the_one_behind_the_first_host(spark):
    want = {
        "http://example.com?next=http://x.org/de/a": ("example.com", "", None),
        "https://a.org#x://b/fr/": ("a.org", "", None),
        "http://Example.com/de/?u=http://x.org/fr/": ("example.com", "/de/", "example.com/de/"),
        "x/y://b.org/fr/1\n2?q#/": ("b.org", "/fr/1\n2", "org/fr/"),
        "http://?a=://c.org/fr/": ("", "", None),
        "http://": ("", "", None),
        ":///p/q": ("", "/p/q", None),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlrules.judged(pages, URL_RULES).collect()}
    assert got == dict(enumerate(want.values()))


def test_words_advance_together_as_one_by_one():
    rng = random.Random(5)
    table = {bytes([b]): (rng.random() * 1e-6, rng.random()) for b in b"abc"}
    table |= {bytes(rng.choices(b"abc", k=rng.randrange(2, 17))): (rng.random(), rng.random() * 1e-5) for _ in range(40)}
    words = [bytes(rng.choices(b"abc", k=n)) for n in [1, 1, 2, 7, 8, 9, 16, 17, 300, 900]] + [p * 3 for p in table]
    want = [langid.log_forward(w, table, 2) for w in words]
    assert np.allclose(langid.Pieces(table, 2).log_forward(words), want)
    assert np.isneginf(langid.Pieces(table, 2).log_forward([b"a", b"ax"])[1]).all()


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_sums_and_expected_counts_by_enumeration():
    rng = random.Random(15)
    table = {bytes([b]): (rng.random(), rng.random()) for b in b"abc"}
    table |= {bytes(rng.choices(b"abc", k=rng.randrange(2, 7))): (rng.random(), 0.0) for _ in range(40)}
    for n in range(1, 13):
        word = bytes(rng.choices(b"abc", k=n))
        for lang in (0, 1):
            found = [(s, math.prod(table[p][lang] for p in s)) for s in segmentations(word, table)]
            whole = math.fsum(x for _, x in found)
            assert math.isclose(langid.log_forward(word, table, 2)[lang], math.log(whole))
            want, got = Counter(), Counter()
            for pieces, x in found:
                for piece in pieces:
                    want[piece] += x / whole
            for piece, share in langid.expected_counts(word, table, langid.prefixes(table), lang):
                got[piece] += share
            assert all(math.isclose(want[p], got[p], abs_tol=1e-12) for p in want | got)
    assert not list(langid.expected_counts(b"abx", table, langid.prefixes(table), 0))
    long = b"abc" * 20_000  # as many cuts as pieces, whatever their length
    shares = list(langid.expected_counts(long, table, langid.prefixes(table), 0))
    assert math.isclose(math.fsum(len(p) * x for p, x in shares), len(long), rel_tol=1e-6)


def test_vocabulary_is_whole():
    path = public_tokenizers.path(LANGUAGE_PIECES)
    kept = set(langid.vocabulary(path))
    with open(path, "rb") as f:
        every = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    texts_ = ["Straße häuser ДЕЙСТВИТЕЛЬНО ありがとうございました", "it's 12:30, don't", "ÉTÉ naïve"]
    words = [langid.spelled(w) for t in texts_ for w in t.split()]
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    assert parts & every == parts & kept
    assert max(map(len, parts & kept)) > 16


def test_language_scores_by_enumeration(spark):
    """Scores of the query's steps: smoothed counts, sums over segmentations, shares of languages."""
    made = [(i, ["sel vent", "salt wind"][i % 2], ["fr", "en"][i % 2]) for i in range(20)]
    rows = spark.createDataFrame([*made, (90, "vent SALT!", None)], "doc_id bigint, text string, lang string")
    model = langid.learnt(rows, public_tokenizers.path(LANGUAGE_PIECES), F.lit(True))
    assert set(model.probs) == set(langid.vocabulary(public_tokenizers.path(LANGUAGE_PIECES)))
    assert all(math.isclose(math.fsum(p[i] for p in model.probs.values()), 1) for i in (0, 1))
    sums = [1.0, 1.0]
    for word in (b" vent", b" salt"):
        for i in (0, 1):
            sums[i] *= math.fsum(math.prod(model.probs[p][i] for p in s) for s in segmentations(word, model.probs))
    got = langid.predicted(rows.where("doc_id = 90"), model).first()
    assert math.isclose(got.score, max(sums) / sum(sums), rel_tol=1e-9)
    assert got.lang_pred == model.langs[sums.index(max(sums))]


def test_language_sums_all_segmentations(spark, documents):
    table = {b"a": (0.5, 0.1), b"b": (0.2, 0.3), b"ab": (0.3, 0.6)}
    assert np.allclose(np.exp(langid.log_forward(b"ab", table, 2)), [0.5 * 0.2 + 0.3, 0.1 * 0.3 + 0.6])
    rng = random.Random(6)
    made = [(i, " ".join(rng.choice(WORDS if i % 2 else ["pierre", "vent", "sel", "champ"]) for _ in range(20)), "en" if i % 2 else "fr") for i in range(60)]
    rows = spark.createDataFrame([*made, (100, None, None), (101, "12 3", "en"), (102, "vent sel", None)], "doc_id bigint, text string, lang string")
    model = langid.learnt(rows, public_tokenizers.path(LANGUAGE_PIECES), F.col("doc_id") < 40)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(rows, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in made)
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "fr"


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_classifiers_on_awkward_rows(spark, documents, operator):
    rng = random.Random(9)
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(30))) for i in range(60)]
    bad = [(100 + i, " ".join(rng.choice([*WORDS, "idiot", "you", "###"]) for _ in range(30))) for i in range(40)]
    rows = [*good, *bad, (300, None), (301, ""), (302, "x" * 5000), (None, "salt")]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in good + bad] + [(None, 1), (300, None)], "doc_id bigint, mark int")
    got = {r.doc_id: r.score for r in operator.scored(documents(rows), labels, "mark").collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i >= 100) for i, _ in good + bad]) > 0.9
    nothing = operator.scored(documents(rows), labels.where("false"), "mark")
    assert nothing.count() == len(rows)


def test_empty_tables(spark, documents):
    none = documents([])
    labels = spark.createDataFrame([], "doc_id bigint, mark int")
    assert simhash.near_components(none).count() == 0
    assert simhash.without_near_duplicates(none).count() == 0
    assert recipes.exact_duplicates(none).count() == 0
    assert repeats.without_repeats(none).count() == 0
    assert bpe.round_trip(none, PATH).count() == 0
    assert packing.packed(none, PATH).count() == 0
    assert quality.scored(none, labels, "mark").count() == 0
    assert toxicity.scored(none, labels, "mark").count() == 0
    model = langid.learnt(none, public_tokenizers.path(LANGUAGE_PIECES), F.lit(True))
    assert langid.predicted(none, model).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert maxscore.search(vectors, F.lit(True)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string")
    assert urlrules.judged(pages, URL_RULES).count() == 0


def test_toxicity_labels_that_differ_and_terms_as_a_parameter(spark, documents):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None), (3, 7)], "doc_id bigint, toxic int")
    assert {tuple(r) for r in toxicity.sample(labels, "toxic", 10).collect()} == {(1, 1), (2, 0)}
    docs = documents([(i, "grobian lamp") for i in range(30)] + [(30 + i, "lamp salt") for i in range(30)])
    labelled = docs.select("text", (F.col("doc_id") < 30).cast("int").alias("label"))
    few, none = (toxicity.learnt_lexicon(labelled, n) for n in (5, 0))
    assert few.weight("grobian") > 0 and not none.weight("grobian")


def test_toxicity_carries_rows_along(spark, documents):
    docs = documents([(1, "lamp"), (2, None), (None, "salt"), (2, None)]).selectExpr("*", "7 AS score", "8 AS hits")
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    got = toxicity.scored(docs, labels, "toxic", rest=rest)
    assert got.columns == ["doc_id", "text", "rest", "score"]
    back = got.select("doc_id", "text", "rest.*")
    assert sorted(back.collect(), key=str) == sorted(docs.collect(), key=str)
    rows = toxicity.features(docs, toxicity.Lexicon({"lamp": 1.0}), rest)
    assert sorted(rows.select("doc_id", "text", "rest.*").collect(), key=str) == sorted(docs.collect(), key=str)
    assert toxicity.features(docs, toxicity.Lexicon({}), []).columns == ["doc_id", "text", *toxicity.FEATURES]
