"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before it kept, written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txtrail.llm import packing, recipes, repeats, simhash, toxicity
from txtrail.llm.catalog import TOKENIZER
from txtrail.llm.common import held_out, table
from txtrail.session import new_folder

# Of the words a task of the last stage has met: workers of all stages share an executor.
KEPT_BYTES = 48 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below the threshold, each row judged by its text."""
    learn = table(spark, sf_dir, "labels").where(~held_out())
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    clean = toxicity.scored(docs, learn, "toxic", rest=rest).where(F.col("score") < toxicity.THRESHOLD)
    return clean.select(*[F.col(c if c in ("doc_id", "text") else f"rest.{c}") for c in docs.columns])


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, the one with the smallest doc_id."""
    return recipes.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at a similarity of 0.8 on five-word shingles."""
    return simhash.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the 100-byte strings that an earlier place has, too.

    A character that loses some of its bytes goes whole. Null texts become empty, and
    n_chars is the length of what is left.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = repeats.without_repeats(docs, rest=rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v.as_buffer().to_pybytes().decode("utf-8", "ignore") for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], batch.schema.names[:1] + ["text"] + batch.schema.names[2:])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "kept", *(["rest"] if rest else [])]
    schema = f"doc_id {id_type}, text string" + (f", rest {found.schema['rest'].dataType.simpleString()}" if rest else "")
    texts = found.select(*columns).mapInArrow(run, schema)
    named = texts.select("doc_id", "text", *([F.col("rest.*")] if rest else []))
    if "n_chars" in rest:
        named = named.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return named.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.packed(docs, public_tokenizers.path(TOKENIZER), kept_bytes=KEPT_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


# Trees, fingerprints, suffix arrays and islands are out of reach of SQL.
ORACLE_SQL = None
