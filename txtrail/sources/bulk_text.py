"""Bulk text load: tab-separated fields, newline-separated rows, backslash escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from txtrail.operators.joins import is_small
from txtrail.session import checkpointed

# What a character stands for after a backslash. Any other
# character stands for itself, and a whole field `\N` is NULL.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
NULL_FIELD = "\\N"

BAD_LINE = "_bad_line"

_FIELD = r"(?s)((?:[^\t\\]|\\.)*+)\t"
_TOKEN = r"(?s)(\\.|[^\\]++)"

_SPLIT = ["_file", "_split"]
_PLACE = [*_SPLIT, "_row"]


def read_bulk_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the files under `path`, plus `_bad_line` for lines that do not fit.

    A line break behind a backslash belongs to the field, which goes on in the next line.
    An empty file gives no rows, a missing one raises. A bad line has the wrong
    number of fields, a value that is not of its type, NULL in a required field,
    or ends its file in an open escape; it is reported with all lines it goes over.
    """
    whole = whole_lines(spark, path)
    line = F.col("value")
    # the closing tab lets every field end in the same way
    fields = F.regexp_extract_all(F.concat(line, F.lit("\t")), F.lit(_FIELD), 1)
    split = whole.select(line, fields.alias("_fields"))
    columns, bad = [], is_open(line) | (F.size("_fields") != len(schema.fields))
    for i, field in enumerate(schema.fields):
        raw = F.get(F.col("_fields"), F.lit(i))
        text = F.when(raw != NULL_FIELD, unescape(raw))
        value = text.try_cast(field.dataType)
        columns.append(value.alias(field.name))
        bad = bad | (text.isNotNull() & value.isNull())
        if not field.nullable:
            bad = bad | text.isNull()
    return split.select(*columns, F.when(bad, line).alias(BAD_LINE))


def is_open(line: Column) -> Column:
    """Whether the line break behind this line is escaped.

    Seen by the line alone: an escape that the line before left open ends with its break.
    """
    return F.length(F.regexp_extract(line, r"(\\*)\z", 1)) % 2 == 1


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of the files, those that go on put together with what follows.

    Files are read in splits by many tasks. As long as no line is open, that is all: rows
    are not moved, and the files are looked through once more. Otherwise the lines are
    written out with their places, since a second scan may split the files anew, and
    only open lines and those behind them are shuffled.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    if lines.where(is_open(F.col("value"))).isEmpty():
        return lines
    placed = lines.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
        is_open(F.col("value")).alias("_open"),
    )
    return joined_lines(checkpointed(placed))


def joined_lines(placed: DataFrame) -> DataFrame:
    """(value) from lines with file, split, row (rising within a split) and whether open.

    A split is bounded by its bytes, a file is not: rows are numbered within splits, and
    one row for each split of a file carries on from those before it.
    """
    followers = checkpointed(_followers(placed))
    if is_small(followers):
        followers = F.broadcast(followers)
    flagged = placed.join(followers, _PLACE, "left")
    follows = F.col("_follows").isNotNull()
    alone = flagged.where(~follows & ~F.col("_open")).select("value")
    parts = checkpointed(flagged.where(follows | F.col("_open")))

    # a line ends with each of its parts that is not open; parts with as many ends before
    # them in their file belong together
    ends = F.count_if(~F.col("_open"))
    in_split = Window.partitionBy(*_SPLIT).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    per_split = parts.groupBy(*_SPLIT).agg(ends.alias("_n"))
    earlier = per_split.select(*_SPLIT, F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_earlier"))
    numbered = parts.withColumn("_ends", ends.over(in_split)).join(earlier, _SPLIT)
    number = F.col("_ends") + F.col("_earlier")
    together = numbered.groupBy("_file", number.alias("_number")).agg(
        F.sort_array(F.collect_list(F.struct("_split", "_row", "value"))).alias("_parts")
    )
    return alone.unionByName(together.select(F.array_join("_parts.value", "\n").alias("value")))


def _followers(placed: DataFrame) -> DataFrame:
    """Places right behind an open line: the next row of its split, or the first one of the
    next split of its file that has any row."""
    within = placed.where("_open").select(*_SPLIT, (F.col("_row") + 1).alias("_row"))
    edges = placed.groupBy(*_SPLIT).agg(
        F.min("_row").alias("_first"), F.max(F.struct("_row", "_open")).alias("_last")
    )
    before = F.lag("_last._open").over(Window.partitionBy("_file").orderBy("_split"))
    across = edges.withColumn("_before", before).where("_before").select(*_SPLIT, F.col("_first").alias("_row"))
    return within.unionByName(across).withColumn("_follows", F.lit(True))


def unescape(text: Column) -> Column:
    """Replaces the escapes in one pass from left to right."""

    def literal(token: Column) -> Column:
        char = F.substring(token, 2, 1)
        plain = char
        for key, value in ESCAPES.items():
            plain = F.when(char == key, F.lit(value)).otherwise(plain)
        return F.when(token.startswith("\\"), plain).otherwise(token)

    tokens = F.regexp_extract_all(text, F.lit(_TOKEN), 1)
    return F.when(text.contains("\\"), F.array_join(F.transform(tokens, literal), "")).otherwise(
        text
    )


def escape(text: Column, continued: bool = False) -> Column:
    """Text of one field as `read_bulk_text` expects it; `continued` keeps line breaks as
    such, behind a backslash."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for key, value in ESCAPES.items():
        escaped = "\\\n" if continued and value == "\n" else "\\" + key
        out = F.replace(out, F.lit(value), F.lit(escaped))
    return F.coalesce(out, F.lit(NULL_FIELD))


def write_bulk_text(df: DataFrame, path: str, continued: bool = False) -> None:
    fields = [escape(F.col(c).cast("string"), continued) for c in df.columns]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode("append").text(path)
