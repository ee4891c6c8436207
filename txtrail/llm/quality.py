"""Quality by a regularised quadratic discriminant over document statistics.

Statistics of each whole text are transformed to be about normal. Every class has a mean
and a covariance, shrunk towards the pooled covariance and a multiple of the identity.
The score is the class probability from the difference of the log densities, whose
Mahalanobis distances come from Cholesky factors that are computed once. Counts, sums and
products of the statistics are aggregated by Spark over all labelled rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txtrail.llm.common import sliced
from txtrail.session import checkpointed

POOLED = 0.1
SPHERICAL = 0.01
THRESHOLD = 0.3

FEATURES = [
    "length", "word_length", "upper", "digits", "end_marks", "exclaims", "pipes", "symbols",
    "letters", "lines", "distinct", "repeated", "all_upper", "zipped", "entropy",
]

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_WIDE = _BYTES >= 128
_MARKS = np.isin(_BYTES, list(b".,;:?"))
_EXCLAIM = _BYTES == ord("!")
_PIPE = _BYTES == ord("|")
_SPACE = np.isin(_BYTES, list(b" \t\r\n\x0b\x0c"))
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _WIDE | _MARKS | _EXCLAIM | _PIPE | _SPACE)

# Bytes that are compressed at a time; the ratio is taken over the whole text.
ZIP_STEP = 1 << 16


def share(part: float, whole: float) -> float:
    """A rate on a log scale, where one in a thousand and none are close."""
    return float(np.log(part / max(whole, 1) + 1e-3))


def statistics(data: bytes) -> list[float]:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    n_words = len(words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    upper = sum(map(bytes.isupper, words))
    zipped = sum(len(zlib.compress(data[i : i + ZIP_STEP], 1)) for i in range(0, n, ZIP_STEP))
    used = counts[counts > 0] / max(n, 1)
    letters = counts[_UPPER].sum() + counts[_LOWER].sum() + counts[_WIDE].sum()
    return [
        float(np.log1p(n)),
        float(np.log1p((n - counts[_SPACE].sum()) / max(n_words, 1))),
        share(counts[_UPPER].sum(), letters),
        share(counts[_DIGIT].sum(), n),
        share(counts[_MARKS].sum(), n_words),
        share(counts[_EXCLAIM].sum(), n_words),
        share(counts[_PIPE].sum(), n_words),
        share(counts[_SYMBOL].sum(), n),
        float(letters / max(n, 1)),
        share(counts[10], n_words),
        float(np.log((len(set(words)) + 1) / (n_words + 1))) / float(np.log(n_words + 3)),
        share(repeated, n_words),
        share(upper, n_words),
        float(np.log((zipped + 1) / (n + 20))),
        float(-(used * np.log2(used)).sum()),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of each whole text; null counts as empty."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, x array<double>")


class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], pooled: float, spherical: float) -> None:
        total = sum(n for n, _, _ in moments.values())
        scatter = {k: p / n - np.outer(s / n, s / n) for k, (n, s, p) in moments.items()}
        common = sum(scatter[k] * moments[k][0] for k in moments) / max(total, 1)
        self.classes = {}
        for k, (n, s, _) in moments.items():
            mixed = (1 - pooled - spherical) * scatter[k] + pooled * common
            mixed = mixed + spherical * max(np.trace(common) / len(common), 1e-6) * np.eye(len(common))
            factor = np.linalg.cholesky(mixed)
            log_prior = np.log((n + 1) / (total + 2))
            self.classes[k] = (s / n, np.linalg.inv(factor), np.log(np.diag(factor)).sum(), log_prior)

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        mean, whitening, log_det, log_prior = self.classes[k]
        return log_prior - log_det - 0.5 * (((x - mean) @ whitening.T) ** 2).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1; with a single class, its prior."""
        if len(self.classes) < 2:
            return np.full(len(x), float(1 in self.classes) if self.classes else 0.5)
        difference = self.log_density(x, 1) - self.log_density(x, 0)
        return 1 / (1 + np.exp(-np.clip(difference, -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and products of x by label, added up in the tasks and then by Spark."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            ones = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for k in np.unique(label).tolist():
                own = ones[label == k]
                totals[k] = totals.get(k, 0) + (own.T @ own).ravel()
        for k, values in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array(values)], ["label", "i", "v"]
            )

    summed = labelled.select("label", "x").mapInArrow(run, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v"))
    out = {}
    # (features + 1) squared rows for each of two labels
    for row in summed.collect():
        out.setdefault(row["label"], np.zeros((d + 1) ** 2))[row["i"]] = row["v"]
    squares = {k: v.reshape(d + 1, d + 1) for k, v in out.items()}
    return {k: (m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in squares.items()}


def scored(docs: DataFrame, labels: DataFrame, label: str, pooled: float = POOLED, spherical: float = SPHERICAL) -> DataFrame:
    """(doc_id, score) of each row: probability that `label` is 1.

    `labels` has doc_id and the label (0, 1; others and null are passed over) of the rows to
    learn from; rows that repeat a doc_id count once each. Null and empty texts are scored
    by their statistics like any other. With no label at all every score is 0.5. Columns
    besides doc_id, text and the label are not looked at.
    """
    known = checkpointed(features(docs))
    chosen = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    model = Discriminant(moments(known.join(chosen, "doc_id")), pooled, spherical)
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x))], ["doc_id", "score"])

    return known.mapInArrow(run, f"doc_id {id_type}, score double")
