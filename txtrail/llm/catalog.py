"""Registered queries of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txtrail.llm import bpe, langid, maxscore, mixing, packing, prefixtrie, quality, recipes, repeats, resampling, simhash, toxicity, urlrules
from txtrail.llm import oracle
from txtrail.llm.common import held_out, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = dict(oracle.ORACLE)

TOKENIZER = "byte_bpe_50k.json"
LANGUAGE_PIECES = "byte_bpe_multi_50k.tiktoken"

URL_RULES = [
    urlrules.Listed("net", "/", urlrules.BLOCK),
    urlrules.Listed("example.net", "/en/", urlrules.ALLOW),
    urlrules.Listed("example.com", "/de/", urlrules.BLOCK),
    urlrules.Listed("org", "/fr/", urlrules.ALLOW),
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def judged(scores: DataFrame, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scores.select("doc_id", held_out().alias("held_out"), "score", predicted)


@query
def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(~held_out())
    return judged(quality.scored(table(spark, sf_dir, "documents"), learn, "quality"), quality.THRESHOLD)


@query
def op3_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(~held_out())
    return judged(toxicity.scored(table(spark, sf_dir, "documents"), learn, "toxic"), toxicity.THRESHOLD)


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op4_exact_dedup"] = r"""
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
           count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
)
"""


@query
def op5_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE["op5_maxscore_search"] = """
WITH v AS (
    SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e
    FROM embeddings
    WHERE len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM s
)
SELECT * FROM r WHERE rank <= 20
"""


@query
def op6_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op9_language_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learnt(docs, public_tokenizers.path(LANGUAGE_PIECES), ~held_out())
    return langid.predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query
def op10_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))
