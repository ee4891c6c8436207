"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon joins a short public list with words and word beginnings that a bounded sample
of labelled documents has in toxic texts far more often than in others, so languages that
the list lacks are covered. Features are densities of lexicon words, also spelled with
digits and signs, their closeness to the second person, capitals, punctuation and
obfuscation rates. Trees learn on four fifths of the labelled rows, the calibration on
the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.llm.common import sliced
from txtrail.session import checkpointed

# Labelled documents the lexicon and the trees learn from at most, by the hash of their id.
TRAIN_DOCS = 30_000
# Terms of the lexicon at most; those that tell most come first.
LEXICON_TERMS = 2_000
MIN_TOXIC_DOCS = 3
MIN_RATIO = 12.0
STEM = 5
NEAR_WORDS = 6
KEPT_WORDS = 120_000
THRESHOLD = 0.5

# Insults of the public list, and words of the second person.
INSULTS = "clown disgusting dumb fool freak garbage idiot imbecile loser moron pathetic scum stupid trash ugly vermin worthless".split()
SECOND_PERSON = set("you your yours yourself ur u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú usted ustedes vosotros ti tus".split())
SIGNS = str.maketrans("0134578@$!", "oieastbasi")

EDGES = regex.compile(r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}]+$")
MIXED = regex.compile(r"\p{L}[\d@$!*]+\p{L}")

FEATURES = [
    "hits", "hit_density", "hit_weight", "near_second", "second_density", "hidden_hits",
    "caps", "caps_words", "exclaims", "question_marks", "other_marks", "mixed_words", "words",
]


def plain(word: str) -> str:
    return EDGES.sub("", word).lower()


def stem(word: str) -> str | None:
    return word[:STEM] + "*" if len(word) > STEM else None


class Lexicon:
    """Weight of each term; a term that ends in * is the beginning of a word."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def weight(self, word: str) -> float:
        own = self.weights.get(word, 0.0)
        beginning = stem(word)
        return max(own, self.weights.get(beginning, 0.0) if beginning else 0.0)


def terms(text: str) -> set[str]:
    words = {plain(w) for w in set(text.split())} - {""}
    return words | {s for w in words if (s := stem(w))}


def learnt_lexicon(labelled: DataFrame, most_terms: int = LEXICON_TERMS) -> Lexicon:
    """From text and label (0, 1): terms by how much more often toxic documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: dict[str, list[int]] = {}
            for label, text in zip(batch.column(1).to_pylist(), batch.column(0)):
                for term in terms(text.as_py() or ""):
                    counts.setdefault(term, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]], ["term", "clean", "toxic"]
            )

    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0) + 1, sizes.get(1, 0) + 1
    counted = labelled.select("text", "label").mapInArrow(run, "term string, clean bigint, toxic bigint")
    ratio = ((F.col("toxic") + 0.1) / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    chosen = (
        counted.groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where(F.col("toxic") >= max(MIN_TOXIC_DOCS, n_toxic / 400))
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= MIN_RATIO)
        .orderBy(F.desc(F.col("toxic") * F.log("ratio")), "term")
        .limit(most_terms)
        .collect()
    )
    weights = {w: 1.0 for w in INSULTS}
    weights |= {r["term"]: min(1.0, float(np.log(r["ratio"])) / 4) for r in chosen}
    return Lexicon(weights)


class WordKinds(dict):
    """What is known of each word as a row: weight, hidden, second person, capitals, mixed."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        clean = plain(word)
        weight = self.lexicon.weight(clean)
        hidden = 0
        if not weight and not clean.isalpha():
            weight = self.lexicon.weight(regex.sub(r"[^\p{L}]", "", clean.translate(SIGNS)))
            hidden = weight > 0
        code = (
            round(weight * 255)
            | hidden << 8
            | (clean in SECOND_PERSON) << 9
            | (len(clean) > 1 and word.isupper()) << 10
            | (MIXED.search(word) is not None) << 11
        )
        self[word] = code
        return code


def dense(text: str, kinds: WordKinds) -> list[float]:
    words = text.split()
    n = max(len(words), 1)
    codes = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
    weight = (codes & 255) / 255
    hit = np.nonzero(weight)[0]
    second = np.nonzero(codes >> 9 & 1)[0]
    near = 0
    if len(hit) and len(second):
        at = np.searchsorted(second, hit)
        before = hit - second[np.maximum(at - 1, 0)]
        behind = second[np.minimum(at, len(second) - 1)] - hit
        near = int(((np.abs(before) <= NEAR_WORDS) | (np.abs(behind) <= NEAR_WORDS)).sum())
    letters = max(sum(map(len, words)), 1)
    return [
        float(np.log1p(len(hit))),
        len(hit) / n,
        float(weight.sum()) / n,
        near / n,
        len(second) / n,
        float(np.log1p((codes >> 8 & 1).sum())),
        sum(1 for w in words if w[0].isupper()) / n,
        float((codes >> 10 & 1).sum()) / n,
        text.count("!") / letters,
        text.count("?") / letters,
        sum(map(text.count, "#$%&*@")) / letters,
        float((codes >> 11 & 1).sum()) / n,
        float(np.log1p(len(words))),
    ]


def along(rest: list[str] | None) -> list[str]:
    """Columns that come along with a score."""
    return ["doc_id"] if rest is None else ["doc_id", "text", *(["rest"] if rest else [])]


def features(docs: DataFrame, lexicon: Lexicon, rest: list[str] | None = None) -> DataFrame:
    """(doc_id, features...) of each whole text; null counts as empty.

    With `rest`, the text and a struct `rest` of those columns come along.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = docs.select("doc_id", "text", *([F.struct(*rest).alias("rest")] if rest else []))
    kept = along(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = WordKinds(held.value)
        for batch in sliced(batches):
            found = [dense(t.as_py() or "", kinds) for t in batch.column(1)]
            columns = [pa.array([r[i] for r in found], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, *FEATURES])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in kept] + [T.StructField(f, T.DoubleType()) for f in FEATURES]))


def sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label): at most about `most` of the labelled documents, by the hash of the id;
    a document labelled more than once is 1 if any label says so."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    return known.where(place < most / n) if n > most else known


def scored(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    most: int = TRAIN_DOCS,
    rest: list[str] | None = None,
    most_terms: int = LEXICON_TERMS,
) -> DataFrame:
    """(doc_id, score) of each row: calibrated probability that `label` is 1.

    With `rest`, the text and a struct `rest` of those columns come along, so that rows can
    be kept or dropped by their score without a join that moves the texts.

    `labels` has doc_id and the label (0, 1; others and null are passed over) of the rows to
    learn from. Null and empty texts are scored by their features like any other. Where the
    labelled rows are of one class only, or none, every score is that class, or 0. A
    document with labels of both kinds counts as 1. The lexicon has the most_terms terms that
    tell most. Whole texts count, however long. Columns besides doc_id, text and the label
    are not looked at.
    """
    # a bounded set of ids, so it may be broadcast
    chosen = checkpointed(sample(labels, label, most))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    learnt = checkpointed(texts.select("doc_id", "text", "label"))
    classes = sorted(r["label"] for r in learnt.select("label").distinct().collect())
    if len(classes) < 2:
        rows = docs.select("doc_id", "text", *([F.struct(*rest).alias("rest")] if rest else []))
        return rows.select(*along(rest), F.lit(float(classes[0]) if classes else 0.0).alias("score"))
    lexicon = learnt_lexicon(learnt, most_terms)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    known = checkpointed(features(learnt, lexicon).join(chosen, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))))
    rows = assembler.transform(known).select("features", F.col("label").cast("double").alias("label"), "part")
    fitting = checkpointed(rows.where("part > 0"))
    two = fitting.select("label").distinct().count() == 2
    trees = GBTClassifier(maxDepth=4, maxIter=20, stepSize=0.2, seed=11, subsamplingRate=1.0).fit(fitting if two else rows)

    def margin(frame: DataFrame) -> DataFrame:
        out = trees.transform(frame)
        return out.withColumn("margin", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    curved = margin(rows.where("part = 0")) if two else margin(rows)
    both = curved.select("margin", "label").union(margin(fitting).select("margin", "label")) if curved.isEmpty() else curved
    curve = IsotonicRegression(featuresCol="margin", labelCol="label").fit(both)
    kept = along(rest)
    all_ = margin(assembler.transform(features(docs, lexicon, rest)).select(*kept, "features"))
    # a step of the curve keeps the order of the trees inside it
    fitted = curve.transform(all_)
    return fitted.select(*kept, (0.98 * F.col("prediction") + 0.02 * F.col("margin")).alias("score"))
