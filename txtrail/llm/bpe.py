"""Byte-level BPE with a contiguous array of ranks per word, and its way back.

A word is held as its part boundaries beside the ranks of adjacent parts. The smallest
rank is searched, its boundary deleted and the ranks on both sides looked up again. The
search is a scan of a few entries; words over LONG_WORD bytes keep their ranks in a heap,
so that unbroken text of any length takes n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from txtrail.llm.common import sliced

# Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_WORD = 256
NO_RANK = 1 << 60
# Bytes of known words that a worker keeps, about; longer words are not kept.
KEPT_BYTES = 128 << 20
KEPT_CHARS = 48
ENTRY_BYTES = 180


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes are
    themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(0x100 + i): b for i, b in enumerate(others)}


class Known(dict):
    """Ids of words met before, in two generations: when the newer one is full it becomes the
    older one, whose words move back when they are met again, so frequent words stay."""

    def __init__(self, most_bytes: int) -> None:
        super().__init__()
        self.most = max(1, most_bytes // 2 // ENTRY_BYTES)
        self.older: dict[str, bytes] = {}

    def add(self, word: str, ids: bytes) -> None:
        if len(word) > KEPT_CHARS:
            return
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids

    def again(self, word: str) -> bytes | None:
        """Of the older generation."""
        ids = self.older.get(word)
        if ids is not None:
            self.add(word, ids)
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Codec:
    """Encoder and decoder of one tokenizer file; a Python worker builds it once."""

    _by_path: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        token_bytes = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if set(t) <= letters.keys()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        token_id = {t: i for t, i in spec["model"]["vocab"].items()}
        # the rank of a pair of parts is the place of its merge
        self.ranks = {token_id[a] << 32 | token_id[b]: n for n, (a, b) in enumerate(pairs)}
        self.merged = [token_id[a + b] for a, b in pairs]
        self.first = [token_bytes[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = [b""] * (1 + max([*token_bytes.values(), *self.special.values()]))
        for token, i in token_bytes.items():
            self.tokens[i] = token
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.numerals = [str(i) for i in range(len(self.tokens))]
        self.pattern = regex.compile(PATTERN)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        # stretches between spaces, and the few words that are none
        self.kept_bytes = 0
        self.keep(KEPT_BYTES)

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def keep(self, most_bytes: int) -> None:
        """Starts anew with room for so many bytes of words, if that is a change."""
        if most_bytes == self.kept_bytes:
            return
        self.kept_bytes = most_bytes
        # stretches between spaces, and the few words that are none
        self.pieces, self.words = Known(most_bytes * 3 // 4), Known(most_bytes // 4)

    def forget(self) -> None:
        """Drops the words met so far; the vocabulary stays."""
        self.pieces.forget()
        self.words.forget()

    # --- words ---

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word's parts when no merge applies any more."""
        if len(word) > LONG_WORD:
            return self.merge_long(word)
        rank, first = self.ranks.get, self.first
        parts = [first[b] for b in word]
        ranks = [rank(a << 32 | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            i = ranks.index(least)
            here = parts[i] = self.merged[least]
            # the boundary behind part i goes
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(here << 32 | parts[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | here, NO_RANK)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        """The same by a heap of (rank, start) over linked parts."""
        n = len(word)
        parts = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        current = [NO_RANK] * n
        heap: list[tuple[int, int]] = []

        def look(i: int) -> None:
            current[i] = NO_RANK
            if after[i] < n:
                current[i] = self.ranks.get(parts[i] << 32 | parts[after[i]], NO_RANK)
                if current[i] != NO_RANK:
                    heapq.heappush(heap, (current[i], i))

        for i in range(n):
            look(i)
        while heap:
            least, i = heapq.heappop(heap)
            if current[i] != least:
                continue
            gone = after[i]
            parts[i], after[i] = self.merged[least], after[gone]
            if after[i] < n:
                before[after[i]] = i
            current[gone] = NO_RANK
            look(i)
            if i:
                look(before[i])
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return out

    def word(self, word: str) -> bytes:
        found = self.words.get(word) or self.words.again(word)
        if found is None:
            found = array("I", self.merge(word.encode())).tobytes()
            self.words.add(word, found)
        return found

    def piece(self, text: str) -> bytes:
        return b"".join(map(self.word, self.pattern.findall(text)))

    # --- texts ---

    def plain(self, text: str) -> list[bytes]:
        """Ids of a text without special tokens, in stretches.

        A word begins before every space with something other than space behind it, so
        texts are cut there and the stretches are looked up whole.
        """
        cut = text.split(" ")
        found: list = list(map(self.pieces.get, cut))
        found[0] = self.piece(cut[0])
        if None not in found:
            return found
        if any(not p or p[0].isspace() for p in cut[1:]):
            cut = joined(cut)
            found = [None] * len(cut)
            found[0] = self.piece(cut[0])
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self.kept(cut[i])
        return found

    def kept(self, cut: str) -> bytes:
        ids = self.pieces.get(cut) or self.pieces.again(cut)
        if ids is None:
            # letters alone are one word of the pattern
            ids = array("I", self.merge(f" {cut}".encode())).tobytes() if cut.isalpha() else self.piece(" " + cut)
            self.pieces.add(cut, ids)
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids as the tokenizer gives them without adding special tokens of its own."""
        if self.marks is None or not any(m in text for m in self.special):
            return np.frombuffer(b"".join(self.plain(text)), "<u4")
        out: list[bytes] = []
        for n, part in enumerate(self.marks.split(text)):
            if n % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.extend(self.plain(part))
        return np.frombuffer(b"".join(out), "<u4")

    def decimals(self, ids: np.ndarray) -> bytes:
        return ",".join(map(self.numerals.__getitem__, ids.tolist())).encode()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def joined(cut: list[str]) -> list[str]:
    """Stretches that begin with white space or are empty belong to the one before."""
    out: list[list[str]] = [[cut[0]]]
    for piece in cut[1:]:
        if piece and not piece[0].isspace():
            out.append([piece])
        else:
            out[-1].append(piece)
    return [" ".join(parts) for parts in out]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text; none for a null or empty one."""
    return _mapped(docs, path, [("ids", T.ArrayType(T.IntegerType(), False))], lambda codec, ids: [ids.astype(np.int32)])


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the text of each list of ids; null ids are an empty list."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [codec.decode(v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.array([], int)) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], schema.names)

    return rows.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text.

    Null texts count as empty; repeated rows come once each; columns besides doc_id and
    text are not looked at. The same codec as in `encoded` and `decoded`, without moving
    the ids.
    """

    def digests(codec: Codec, ids: np.ndarray) -> list:
        text = codec.decode(ids)
        return [len(ids), hashlib.sha256(codec.decimals(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]

    columns = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _mapped(docs, path, columns, digests)


def _mapped(docs: DataFrame, path: str, columns: list, make) -> DataFrame:
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, t) for n, t in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        kinds = [pa.list_(pa.int32()) if n == "ids" else pa.int64() if n == "n_tokens" else pa.string() for n, _ in columns]
        for batch in sliced(batches):
            rows = [make(codec, codec.encode(t.as_py() or "")) for t in batch.column(1)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
