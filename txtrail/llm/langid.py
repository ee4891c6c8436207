"""Language by unigram pieces, summed over all segmentations.

The pieces are the byte strings of a public vocabulary. A word is scored by the forward
algorithm: the probability that some sequence of pieces, drawn from the language's
distribution, spells it, whatever the segmentation. The distributions are learnt by
expectation maximisation, whose expected counts come from forward and backward sums over
the words of a bounded sample of labelled documents, as Spark jobs over distinct words.
"""

from __future__ import annotations

import base64
import math
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txtrail.llm.common import sliced
from txtrail.session import checkpointed

UNKNOWN = "und"
# Documents a language is learnt from, by the order of their hashes; about this many.
TRAIN_DOCS = 400
ROUNDS = 2
KEPT_WORDS = 300_000
# New words are scored in blocks of about this many bytes, longer words one at a time.
BLOCK_BYTES = 1 << 18
LONG_WORD = 1 << 12
# Sums are rescaled after this many bytes, before they leave the range of a double.
RESCALE = 8

NO_LETTER = regex.compile(r"[^\p{L}]+")


# No word has these bytes, see `spelled`; a space is only at its start.
NOT_IN_WORDS = re.compile(rb"[\x00-\x1f\x21-\x60\x7b-\x7f]|(?<!^) ", re.DOTALL)


def vocabulary(path: str) -> list[bytes]:
    """All pieces of the file that can be part of a spelled word, of any length."""
    with open(path, "rb") as f:
        pieces = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return [p for p in pieces if not NOT_IN_WORDS.search(p)]


def spelled(word: str) -> bytes:
    """Letters of a word in lower case behind a space; nothing if it has none."""
    letters = (word if word.isalpha() else NO_LETTER.sub("", word)).lower()
    return f" {letters}".encode() if letters else b""


def log_forward(word: bytes, table: dict, n_langs: int) -> list[float]:
    """Log probability of a word in each language, over all segmentations.

    Only the sums of the last places are held, so a word may be of any length.
    """
    longest = max(map(len, table), default=0)
    sums = {0: [1.0] * n_langs}
    logs = [0.0] * n_langs
    for end in range(1, len(word) + 1):
        totals = [0.0] * n_langs
        for start, before in sums.items():
            probs = table.get(word[start:end])
            if probs is not None:
                totals = [t + b * p for t, b, p in zip(totals, before, probs)]
        sums[end] = totals
        sums.pop(end - longest, None)
        if end % RESCALE == 0:
            scales = [1 / t if t else 1.0 for t in totals]
            sums = {at: [x * k for x, k in zip(row, scales)] for at, row in sums.items()}
            logs = [x - math.log(k) for x, k in zip(logs, scales)]
    return [math.log(t) + x if t else -math.inf for t, x in zip(sums[len(word)], logs)]


def prefixes(pieces: Iterable[bytes]) -> set[bytes]:
    return {p[:n] for p in pieces for n in range(1, len(p) + 1)}


def starting(word: bytes, start: int, table: dict, begun: set[bytes]) -> Iterator[tuple[int, object]]:
    """(end, entry) of the pieces that start there."""
    for end in range(start + 1, len(word) + 1):
        piece = word[start:end]
        if piece not in begun:
            return
        if piece in table:
            yield end, table[piece]


def expected_counts(word: bytes, table: dict, begun: set[bytes], lang: int) -> Iterator[tuple[bytes, float]]:
    """Expected number of each piece in a word of any length, place by place.

    Two numbers are held for each byte: the log of its forward sum, and the share of all
    segmentations that cut there. Nothing comes of a word that no segmentation spells.
    """
    logs = array("d", [0.0]) + array("d", [-math.inf]) * len(word)
    arriving: dict[int, list[tuple[int, float]]] = {}
    for start in range(len(word)):
        if logs[start] > -math.inf:
            for end, probs in starting(word, start, table, begun):
                arriving.setdefault(end, []).append((start, probs[lang]))
        steps = [(logs[at], p) for at, p in arriving.pop(start + 1, ()) if p > 0]
        if steps:
            most = max(x for x, _ in steps)
            logs[start + 1] = most + math.log(math.fsum(p * math.exp(x - most) for x, p in steps))
    if logs[-1] == -math.inf:
        return
    cut = array("d", [0.0]) * len(word) + array("d", [1.0])
    for start in range(len(word) - 1, -1, -1):
        for end, probs in starting(word, start, table, begun) if logs[start] > -math.inf else ():
            if cut[end] and probs[lang]:
                share = probs[lang] * cut[end] * math.exp(logs[start] - logs[end])
                cut[start] += share
                yield word[start:end], share


class Model:
    """Languages and piece probabilities; a table of at most (pieces x languages) numbers."""

    def __init__(self, langs: list[str], probs: dict[bytes, tuple[float, ...]]) -> None:
        self.langs, self.probs = langs, probs


def sample(docs: DataFrame, lang: Column, learn: Column, per_lang: int) -> DataFrame:
    """(lang, text): about per_lang documents of each language, by the hash of their id."""
    rows = docs.where(learn & lang.isNotNull() & F.col("text").isNotNull())
    counts = {r["l"]: r["n"] for r in rows.groupBy(lang.alias("l")).agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = F.lit(False)
    for name, n in counts.items():
        chosen = chosen | ((lang == name) & (place < per_lang / n))
    return rows.where(chosen).select(lang.alias("lang"), "text")


def learnt(docs: DataFrame, path: str, learn: Column, per_lang: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model:
    """Probabilities from the column lang of the rows that `learn` picks."""
    chosen = sample(docs, F.col("lang"), learn, per_lang)

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            counts: dict[tuple[str, bytes], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word in text.as_py().split():
                    key = (lang, spelled(word))
                    if key[1]:
                        counts[key] = counts.get(key, 0) + 1
            if counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    ["lang", "word", "n"],
                )

    words = checkpointed(
        chosen.select("lang", "text").mapInArrow(words_of, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    # from the start every piece is as likely as any other
    probs: dict[bytes, tuple[float, ...]] | None = None
    for _ in range(rounds):
        held = words.sparkSession.sparkContext.broadcast(probs)

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = held.value
            if table is None:
                pieces = vocabulary(path)
                table = {p: (1 / len(pieces),) * len(langs) for p in pieces}
            begun = prefixes(table)
            for batch in batches:
                totals: dict[tuple[str, bytes], float] = {}
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                    for piece, share in expected_counts(word, table, begun, langs.index(lang)):
                        totals[lang, piece] = totals.get((lang, piece), 0.0) + share * n
                if totals:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in totals]), pa.array([k[1] for k in totals], pa.binary()), pa.array(list(totals.values()))],
                        ["lang", "piece", "n"],
                    )

        # at most one row for each language and piece of the vocabulary
        expected = words.mapInArrow(expect, "lang string, piece binary, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        probs = smoothed(expected, langs, vocabulary(path))
    return Model(langs, probs or {})


def smoothed(expected: list, langs: list[str], pieces: list[bytes], weight: float = 0.1) -> dict[bytes, tuple[float, ...]]:
    """Every piece of the vocabulary in every language; each counts `weight` more than expected."""
    counts = {p: [weight] * len(langs) for p in pieces}
    for row in sorted(expected, key=lambda r: (bytes(r["piece"]), r["lang"])):
        counts[bytes(row["piece"])][langs.index(row["lang"])] += row["n"]
    totals = [math.fsum(c[i] for c in counts.values()) for i in range(len(langs))]
    return {p: tuple(x / t for x, t in zip(c, totals)) for p, c in counts.items()}


class Pieces:
    """The pieces as a trie in arrays: sorted (node, byte) keys, whose places are the children.

    Nodes are numbered by (length, bytes) of their prefix, so the keys come out sorted.
    """

    def __init__(self, probs: dict[bytes, tuple[float, ...]], n_langs: int) -> None:
        begun = sorted(prefixes(probs), key=lambda p: (len(p), p))
        node = {b"": 0} | {p: i + 1 for i, p in enumerate(begun)}
        self.longest = max(map(len, probs), default=0)
        self.keys = np.array([node[p[:-1]] << 8 | p[-1] for p in begun], np.int64)
        self.piece = np.full(len(node), -1, np.int32)
        for i, p in enumerate(probs):
            self.piece[node[p]] = i
        self.probs = np.array(list(probs.values()), np.float64).reshape(len(probs), n_langs)

    def found(self, data: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all pieces in the bytes; stops has the word end of each byte."""
        starts = np.arange(len(data), dtype=np.int32)
        node = np.zeros(len(data), np.int64)
        out = []
        for depth in range(self.longest):
            inside = starts + depth < stops[starts]
            starts, node = starts[inside], node[inside]
            wanted = node << 8 | data[starts + depth]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            hit = self.keys[at] == wanted
            starts, node = starts[hit], at[hit] + 1
            piece = self.piece[node]
            ends = piece >= 0
            out.append((starts[ends], np.full(int(ends.sum()), depth + 1, np.int32), piece[ends]))
        starts, lengths, pieces = map(np.concatenate, zip(*out))
        return starts, lengths, pieces

    def log_forward(self, words: list[bytes]) -> np.ndarray:
        """As `log_forward` of each word: all words advance by one byte together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        starts, lengths, pieces = self.found(data, (first + sizes)[word])
        # a word of n bytes has n + 1 places
        zero = first + np.arange(len(words))
        begin = starts + word[starts]
        end = begin + lengths
        step = end - zero[word[starts]]
        # stable, so that a word's sum does not depend on the others in the block
        order = np.argsort(step * (len(data) + len(words) + 1) + end, kind="stable")
        begin, end, pieces = begin[order], end[order], pieces[order]
        longest = int(sizes.max())
        bounds = np.searchsorted(step[order], np.arange(1, longest + 2))
        sums = np.zeros((len(data) + len(words), self.probs.shape[1]))
        logs = np.zeros((len(words), self.probs.shape[1]))
        sums[zero] = 1.0
        for t in range(1, longest + 1):
            a, b = bounds[t - 1], bounds[t]
            if a < b:
                to = end[a:b]
                heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                sums[to[heads]] = np.add.reduceat(sums[begin[a:b]] * self.probs[pieces[a:b]], heads, axis=0)
            if t % RESCALE == 0:
                going = np.flatnonzero(sizes >= t)
                last = sums[zero[going] + t]
                scale = 1 / np.where(last > 0, last, 1.0)
                for back in range(min(self.longest, t + 1)):
                    sums[zero[going] + t - back] *= scale
                logs[going] -= np.log(scale)
        with np.errstate(divide="ignore"):
            return np.log(sums[zero + sizes]) + logs


class WordScores:
    """Rows of words in a growing table of log probabilities; row 0 has no letters."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.pieces = Pieces(model.probs, len(model.langs))
        self.forget()

    def forget(self) -> None:
        self.row_of: dict[str, int] = {}
        self.row_of_letters: dict[bytes, int] = {b"": 0}
        self.rows = np.zeros((1024, len(self.model.langs)))

    def learn(self, words: set[str]) -> None:
        """Rows for words not met before, in blocks of bounded size."""
        letters = {w: spelled(w) for w in words}
        block: list[bytes] = []
        held = 0
        for plain in set(letters.values()) - self.row_of_letters.keys():
            if len(plain) > LONG_WORD:
                self.add([plain], np.array([log_forward(plain, self.model.probs, len(self.model.langs))]))
                continue
            block.append(plain)
            held += len(plain)
            if held >= BLOCK_BYTES:
                self.add(block, self.pieces.log_forward(block))
                block, held = [], 0
        if block:
            self.add(block, self.pieces.log_forward(block))
        self.row_of |= {w: self.row_of_letters[p] for w, p in letters.items()}

    def add(self, words: list[bytes], logs: np.ndarray) -> None:
        used = len(self.row_of_letters)
        while len(self.rows) < used + len(words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[used : used + len(words)] = logs
        self.row_of_letters |= {w: used + i for i, w in enumerate(words)}

    def of(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Summed log probabilities of each text; nothing where no word has a letter."""
        if len(self.row_of) > KEPT_WORDS:
            self.forget()
        found: set[str] = set()
        for text in texts:
            found.update((text or "").split())
        self.learn(found - self.row_of.keys())
        out: list[np.ndarray | None] = []
        for text in texts:
            words = (text or "").split()
            rows = np.fromiter(map(self.row_of.__getitem__, words), np.int64, len(words))
            rows = rows[rows > 0]
            out.append(self.rows[rows].sum(axis=0) if len(rows) else None)
        return out


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text.

    The score is the language's share of the probability, all languages being as likely
    beforehand. Texts that are null or without a letter are `und` with score 0, and so is
    every text where no language was learnt. Repeated rows come once each; columns besides
    doc_id and text are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = held.value.langs
        scores = WordScores(held.value) if langs else None
        for batch in sliced(batches):
            names, shares = [], []
            for found in scores.of(batch.column(1).to_pylist()) if scores else [None] * batch.num_rows:
                if found is None:
                    names.append(UNKNOWN)
                    shares.append(0.0)
                else:
                    best = int(found.argmax())
                    names.append(langs[best])
                    shares.append(float(1 / np.exp(found - found[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
