"""URL filter by association rules, with DataFrame and SQL functions alone.

URLs that a hand-written list covers are the labels. Spark's FP-growth mines which
combinations of URL tokens go with a label; rules that are confident and frequent enough,
and more confident than every rule with fewer tokens, are kept. Each rule is indexed by
its rarest token, so a URL only meets the rules that one of its tokens points at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txtrail.llm.common import join_groups
from txtrail.session import checkpointed

ALLOW, BLOCK = "allow", "block"
# A table of tokens or rules of more rows than this is joined by a shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Listed:
    """A verdict for a host with all its subdomains and paths with a prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ://; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark or hash, A-Z in lower case."""
    host = F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the slash right behind the host up to a question mark or hash; empty without it."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def fits(rule: Listed, host: Column, path: Column) -> Column:
    inside = (host == rule.host) | host.endswith("." + rule.host)
    return inside & path.startswith(rule.path)


def longest_listed(rules: list[Listed], host: Column, path: Column) -> Column:
    """Name and verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        named = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits(rule, host, path), named).otherwise(found)
    return found


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, and words of the path; numbers count as one token."""
    words = F.split(F.lower(F.concat(host, F.lit("/"), path)), r"[^\p{L}\p{N}]+")
    named = F.transform(words, lambda w: F.when(w.rlike(r"^\p{N}+$"), F.lit("#")).otherwise(w))
    return F.array_distinct(F.filter(named, lambda w: w != ""))


@dataclass(frozen=True)
class Mined:
    """Rules over classes of tokens, and the class of each token that can be in a rule."""

    rules: DataFrame  # tokens (one of each class), verdict, confidence, support
    classes: DataFrame  # token, class


def token_classes(rows: DataFrame, least: int) -> DataFrame:
    """(class, members, n, blocked): tokens of at least so many rows; those of the same rows are one class.

    `rows` has row, tokens and verdict. Rows are told by 128 bits of their numbers.
    """
    counted = (
        rows.select(F.explode("tokens").alias("token"), "row", "verdict")
        .groupBy("token")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("verdict") == BLOCK).alias("blocked"),
            F.bit_xor(F.xxhash64("row")).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"),
        )
        .where(F.col("n") >= least)
    )
    # tokens of the same rows: no more than a URL has
    return counted.groupBy("n", "blocked", "x", "y").agg(
        F.min("token").alias("class"), F.collect_list("token").alias("members")
    )


def mine(labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int, min_rows: int) -> Mined:
    """The kept rules, from columns tokens and verdict (allow or block).

    A rule's tokens go with its verdict in at least min_rows rows and in min_support of
    all. What one token says is counted first. FP-growth then mines combinations, without
    what cannot give a rule of its own: rare tokens, tokens of the same rows as another
    (they are one class), and tokens that always go with one verdict, since no combination
    with them is more confident.
    """
    rows = checkpointed(labelled.select("tokens", "verdict").withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()
    least = max(min_rows, math.ceil(min_support * total))
    found = checkpointed(token_classes(rows, least))
    by_verdict = F.explode(F.create_map(F.lit(BLOCK), F.col("blocked"), F.lit(ALLOW), F.col("n") - F.col("blocked")))
    single = (
        found.select(F.array("class").alias("tokens"), "n", by_verdict.alias("verdict", "hits"))
        .where((F.col("hits") >= least) & (F.col("hits") / F.col("n") >= min_confidence))
        .select("tokens", "verdict", (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / total).alias("support"))
    )
    classes = found.select(F.explode("members").alias("token"), "class")
    undecided = found.where((F.col("blocked") > 0) & (F.col("blocked") < F.col("n"))).select("class")
    # one token of each class stands for it
    items = few(rows.select("row", "verdict", F.explode("tokens").alias("class")), undecided, "class")
    items = items.groupBy("row", "verdict").agg(F.collect_set("class").alias("tokens"))
    marked = items.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    # rows without such a token are not among them; half a row keeps clear of rounding
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, marked.count())), minConfidence=min_confidence).fit(marked)
    several = (
        model.associationRules.where(F.col("consequent")[0].startswith("="))
        .where(F.size("antecedent").between(2, max_tokens))
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substring(F.col("consequent")[0], 2, 100).alias("verdict"),
            "confidence",
            (F.col("support") * F.lit(marked.count()) / total).alias("support"),
        )
    )
    rules = checkpointed(single.union(several))
    # a rule with fewer tokens that is as confident says the same about more URLs
    fewer, more = rules.alias("f"), rules.alias("m")
    token = F.explode("m.tokens").alias("token")
    beaten = (
        more.select("m.*", token)
        .join(fewer.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("tokens")[0].alias("token")), "token")
        .where("v = verdict AND c >= confidence AND size(part) < size(tokens) AND size(array_except(part, tokens)) = 0")
        .select("tokens", "verdict")
    )
    return Mined(checkpointed(rules.join(beaten.distinct(), ["tokens", "verdict"], "left_anti")), classes)


def few(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Inner join with a table of one row a key: broadcast up to BROADCAST_ROWS of them, else shuffled.

    `known` is written first, so that adaptive execution can split a frequent key.
    """
    known = checkpointed(known)
    return rows.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, key)


def matches(pages: DataFrame, mined: Mined) -> DataFrame:
    """(key, verdict): of the rules whose tokens a URL all has, the most confident one's;
    then the one with more support, then the blocking one."""
    rules = mined.rules
    used = rules.select(F.explode("tokens").alias("class")).distinct()
    classes = mined.classes.join(used, "class")
    # a URL has a class if it has any token of it
    of_url = few(pages.select("key", F.explode("tokens").alias("token")), classes, "token")
    of_url = checkpointed(of_url.groupBy("key").agg(F.collect_set("class").alias("tokens")))
    frequency = of_url.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    spread = rules.withColumn("rule", F.xxhash64("tokens", "verdict")).withColumn("token", F.explode("tokens"))
    index = (
        spread.join(frequency, "token", "left")
        .groupBy("rule", "tokens", "verdict", "confidence", "support")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("rarest"))
        .select(F.col("rarest.token").alias("token"), F.struct("tokens", "verdict", "confidence", "support").alias("rule"))
        .groupBy("token")
        .agg(F.collect_list("rule").alias("rules"))
    )
    probed = few(of_url.select("key", "tokens", F.explode("tokens").alias("token")), index, "token")
    fitting = F.filter("rules", lambda r: F.size(F.array_except(r["tokens"], F.col("tokens"))) == 0)
    best = F.array_max(
        F.transform(fitting, lambda r: F.struct(r["confidence"].alias("c"), r["support"].alias("s"), r["verdict"].alias("verdict")))
    )
    return probed.select("key", best.alias("best")).groupBy("key").agg(F.max("best").alias("best")).select("key", F.col("best.verdict").alias("mined"))


def judged(
    pages: DataFrame,
    rules: list[Listed],
    min_support: float = 0.01,
    min_confidence: float = 0.6,
    max_tokens: int = 4,
    min_rows: int = 5,
    default: str = ALLOW,
) -> DataFrame:
    """Each row's page_id with host, path, rule and verdict.

    The listed rule decides where one fits, the mined rules elsewhere, and `default` where
    none applies. A URL that is null or has no :// has an empty host and path and gets the
    default. Repeated rows come once each; columns besides page_id and url are not looked at.
    A URL of any length takes part with all of its tokens.
    """
    # URLs are judged once for each different host and path
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = split.withColumn("listed", longest_listed(rules, F.col("host"), F.col("path")))
    parsed = checkpointed(listed.withColumn("tokens", tokens(F.col("host"), F.col("path"))))
    labelled = parsed.where("listed is not null").select("tokens", F.col("listed.verdict").alias("verdict"))
    rest = parsed.where("listed is null")
    # a host has no slash and a path begins with one
    rest = rest.withColumn("key", F.concat("host", "path"))
    urls = checkpointed(rest.groupBy("key").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")))
    if labelled.isEmpty():
        mined = urls.select("key", F.lit(None).cast("string").alias("mined"))
    else:
        mined = matches(urls, mine(labelled, min_support, min_confidence, max_tokens, min_rows))
    found = checkpointed(urls.select("key", "n").join(mined, "key", "left"))
    keyed = join_groups(rest, found, "key", "n").select("page_id", "host", "path", "listed", "mined")
    keyed = keyed.union(parsed.where("listed is not null").select("page_id", "host", "path", "listed", F.lit(None).alias("mined")))
    return keyed.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined", F.lit(default)).alias("verdict"),
    )
