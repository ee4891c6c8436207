"""Row-change payloads: action codes, before/after JSON, typed access."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txtrail.functions.timestamps import parse_datetime, parse_duration
from txtrail.schemas import ACTION_CODES, UNKNOWN_ACTION

# Characters written as escapes in payload JSON text.
JSON_ESCAPES = {
    "<": "\\u003c",
    ">": "\\u003e",
    "&": "\\u0026",
    "\u2028": "\\u2028",
    "\u2029": "\\u2029",
}


def action_name(action: Column | str) -> Column:
    action = _col(action)
    names = F.lit(UNKNOWN_ACTION)
    for name, code in ACTION_CODES.items():
        names = F.when(action == code, F.lit(name)).otherwise(names)
    return names


def action_code(event_type: Column | str) -> Column:
    """Code of a row event type; any other type keeps the zero value."""
    event_type = _col(event_type)
    code = F.lit(0)
    for name, value in ACTION_CODES.items():
        code = F.when(event_type == name, F.lit(value)).otherwise(code)
    return code


def payload_json(before: Column, after: Column, map_columns: bool = True) -> Column:
    """`{"before":{...},"after":{...}}` with keys in order and the escapes of JSON_ESCAPES.

    Takes maps, or with `map_columns=False` structs or VARIANTs. A NULL side becomes `{}`.
    """
    options = {"ignoreNullFields": "false"}

    def side(c: Column) -> Column:
        value = F.map_from_entries(F.array_sort(F.map_entries(c))) if map_columns else c
        return F.coalesce(F.to_json(value, options), F.lit("{}"))

    text = F.concat(
        F.lit('{"before":'), side(before), F.lit(',"after":'), side(after), F.lit("}")
    )
    for char, escape in JSON_ESCAPES.items():
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def payload_field(data: Column | str, side: str, name: str) -> Column:
    """Text of one field of the `before` or `after` side; NULL when absent."""
    if side not in ("before", "after"):
        raise ValueError(f"side must be 'before' or 'after', got {side!r}")
    return F.get_json_object(_col(data), f"$['{side}']['{name}']")


@dataclass(frozen=True)
class SourceColumn:
    """Metadata of one column of an audited table."""

    name: str
    type_name: str
    unsigned: bool = False
    nullable: bool = True
    precision: int | None = None
    scale: int | None = None


# Spark type per MySQL type name. Unsigned integers take the next
# wider type; TIME is a signed number of microseconds, as it exceeds a day.
_SIGNED = {
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "MEDIUMINT": T.IntegerType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "YEAR": T.ShortType(),
}
_UNSIGNED = {
    "TINYINT": T.ShortType(),
    "SMALLINT": T.IntegerType(),
    "MEDIUMINT": T.IntegerType(),
    "INT": T.LongType(),
    "BIGINT": T.DecimalType(20, 0),
    "YEAR": T.IntegerType(),
}
_OTHER = {
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampNTZType(),
    "TIME": T.LongType(),
    "NULL": T.NullType(),
}
_TEXT = ["CHAR", "VARCHAR", "TINYTEXT", "TEXT", "MEDIUMTEXT", "LONGTEXT", "ENUM", "SET", "JSON"]
_BYTES = ["BIT", "BINARY", "VARBINARY", "TINYBLOB", "BLOB", "MEDIUMBLOB", "LONGBLOB", "GEOMETRY"]


def spark_type(column: SourceColumn) -> T.DataType:
    name = column.type_name.upper()
    if name == "DECIMAL":
        return T.DecimalType(column.precision or 10, column.scale or 0)
    if name in _TEXT:
        return T.StringType()
    if name in _BYTES:
        return T.BinaryType()
    known = {**_OTHER, **(_UNSIGNED if column.unsigned else _SIGNED)}
    if name not in known:
        raise ValueError(f"unknown column type {column.type_name!r}")
    return known[name]


def payload_schema(columns: Iterable[SourceColumn]) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c), c.nullable) for c in columns])


def with_typed(
    df: DataFrame, columns: Iterable[SourceColumn], data: str = "data"
) -> DataFrame:
    """Adds the structs `before` and `after` with typed columns; NULL for a side without any of them.

    Times and decimals travel as text, so they are read as text and converted with
    the rules for zero dates and long durations. A value that does not fit is NULL.
    """
    columns = list(columns)
    wire = T.StructType([T.StructField(c.name, _wire_type(c)) for c in columns])
    sides = T.StructType([T.StructField("before", wire), T.StructField("after", wire)])
    parsed = computed_once(df, "_payload", F.from_json(F.col(data), sides))

    def typed(side: str) -> Column:
        values = [(F.col(f"_payload.{side}.`{c.name}`"), c) for c in columns]
        present = reduce(or_, [v.isNotNull() for v, _ in values])
        return F.when(present, F.struct(*[_from_wire(v, c).alias(c.name) for v, c in values]))

    return parsed.withColumns({s: typed(s) for s in ("before", "after")}).drop("_payload")


def _wire_type(column: SourceColumn) -> T.DataType:
    target = spark_type(column)
    return target if isinstance(target, T.BinaryType) else T.StringType()


def _from_wire(value: Column, column: SourceColumn) -> Column:
    name, target = column.type_name.upper(), spark_type(column)
    if name in ("DATE", "DATETIME", "TIMESTAMP"):
        return parse_datetime(value)["value"].cast(target)
    if name == "TIME":
        return parse_duration(value)
    if isinstance(target, (T.StringType, T.BinaryType)):
        return value
    if isinstance(target, T.NullType):
        return F.lit(None)
    return value.try_cast(target)


def with_fields(df: DataFrame, side: str, names: Iterable[str], data: str = "data") -> DataFrame:
    """Adds the text column `{side}_{name}` per payload field, parsing the payload once."""
    names = list(names)
    wire = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parsed = F.from_json(F.col(data), T.StructType([T.StructField(side, wire)]))
    rows = computed_once(df, "_payload", parsed)
    fields = {f"{side}_{n}": F.col(f"_payload.{side}.`{n}`") for n in names}
    return rows.withColumns(fields).drop("_payload")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that filters above it do not make Spark compute again.

    A filter is pushed through a projection together with the expressions it refers
    to, but not through a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
