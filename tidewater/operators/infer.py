"""Types of untyped columns from all their values, in one aggregate.

A whole number beyond 64 bits is NUMERIC. A verdict holds for every non-null value (JSON: for four fifths of them), so it does not
depend on the order of rows. TIMESTAMP needs a format that all values have (tidewater.functions.dates). Each value is told apart
once, by the cheapest test first; what has been told to be a number is not tried as a date.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.dates import date_parts, may_be_date, parsed_time, time_formats

BOOLEANS = ("true", "false", "1", "0", "yes", "no", "t", "f")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
WHOLE = r"^[+-]?\d+(\.0*)?$"
JSON = r"^\s*[\[{]"
SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "JSONB": "string", "TEXT": "string"}


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def told(value: str, i: object = "") -> dict[str, str]:
    """SQL for what is told of each value in a first projection: its text and kind."""
    c = f"CAST({value} AS STRING)"
    return {f"text{i}": c, f"kind{i}": f"CASE WHEN rlike({c}, r'{NUMBER}') THEN CASE WHEN rlike({c}, r'{WHOLE}') THEN 'whole' ELSE 'number' END WHEN rlike({c}, r'{JSON}') THEN 'json' WHEN {c} IS NOT NULL THEN 'other' END"}


def left_open(i: object = "", dates: bool = True) -> dict[str, str]:
    """SQL for the second projection, of what the kind leaves open: the whole number, the parts of a date (or only whether it may be one), the short word."""
    text, kind = f"text{i}", f"kind{i}"
    parts = date_parts(text) if dates else may_be_date(text)
    return {f"long{i}": f"CASE WHEN {kind} = 'whole' THEN try_cast(substring_index({text}, '.', 1) AS BIGINT) END", f"parts{i}": f"CASE WHEN {kind} = 'other' THEN {parts} END", f"word{i}": f"CASE WHEN char_length({text}) <= 5 THEN lower({text}) END"}


def facts(i: object = "", dates: bool = True) -> dict[str, str]:
    """SQL for the aggregates of a column; without dates, formats is 0 unless all values may be dates."""
    text, kind, long, word = f"text{i}", f"kind{i}", f"long{i}", f"word{i}"
    number, point = f"{kind} IN ('whole', 'number')", f"instr({text}, '.')"
    truth = f"{word} IN ({', '.join(repr(b) for b in BOOLEANS)})"
    return {
        "n": f"count({text})",
        "json": f"count_if({kind} = 'json')",
        "numbers": f"count_if({number})",
        "whole": f"count_if({kind} = 'whole')",
        "exponents": f"count_if({kind} = 'number' AND rlike({text}, '[eE]'))",
        "wide": f"count_if({kind} = 'whole' AND {long} IS NULL)",
        "least": f"min({long})",
        "most": f"max({long})",
        "digits": f"max(CASE WHEN {number} THEN CASE WHEN {point} > 0 THEN {point} - 1 ELSE char_length({text}) END - CASE WHEN left({text}, 1) IN ('+', '-') THEN 1 ELSE 0 END END)",
        "scale": f"max(CASE WHEN {number} AND {point} > 0 THEN char_length({text}) - {point} END)",
        "formats": f"bit_and(CASE WHEN {kind} IS NOT NULL THEN {time_formats(f'parts{i}') if dates else f'CASE WHEN parts{i} THEN 1 ELSE 0 END'} END)",
        "booleans": f"count_if({truth})",
        # a bit for each of the eight words
        "words": f"bit_count(bit_or(CASE {word} {' '.join(f'WHEN {b!r} THEN {1 << j}' for j, b in enumerate(BOOLEANS))} END))",
    }


def verdict(f: str = "") -> str:
    """SQL for the type's name, from the facts of a column in the struct f (with its dot)."""
    number = f"CASE WHEN {f}whole < {f}n OR {f}wide > 0 THEN 'NUMERIC' WHEN {f}least >= -2147483648 AND {f}most <= 2147483647 THEN 'INTEGER' ELSE 'BIGINT' END"
    return f"CASE WHEN {f}n = 0 THEN 'TEXT' WHEN {f}json * 5 >= {f}n * 4 THEN 'JSONB' WHEN {f}numbers = {f}n THEN {number} WHEN {f}formats > 0 THEN 'TIMESTAMP' WHEN {f}booleans = {f}n AND {f}words <= 2 THEN 'BOOLEAN' ELSE 'TEXT' END"


def numeric(f: str = "") -> str:
    """SQL for Spark's type of a NUMERIC column: a decimal as wide as the digits that are written, or a double where those do not tell."""
    scale = f"coalesce({f}scale, 0)"
    # the digits of a number with an exponent are not those that are written
    return f"CASE WHEN {f}digits + {scale} <= 38 AND {f}exponents = 0 THEN concat('decimal(', greatest({f}digits + {scale}, 1), ',', {scale}, ')') ELSE 'double' END"


def as_type(value: str, name: str, decimal: str, formats: int) -> str:
    """SQL for a value as the type of that name; what does not parse is null."""
    if name == "TIMESTAMP":
        return parsed_time(f"CAST({value} AS STRING)", formats)
    if name in ("INTEGER", "BIGINT"):
        return f"try_cast(regexp_replace(CAST({value} AS STRING), '[.]0*$', '') AS {SPARK_TYPES[name]})"
    return f"try_cast({value} AS {decimal if name == 'NUMERIC' else SPARK_TYPES[name]})"


def _told_of(df: DataFrame, dates: bool) -> dict[str, tuple[str, str, int]]:
    columns = range(len(df.columns))
    listed = lambda made: [f"{x} AS {k}" for k, x in made.items()]
    first = df.selectExpr(*(x for i, c in enumerate(df.columns) for x in listed(told(quoted(c), i))))
    second = first.selectExpr("*", *(x for i in columns for x in listed(left_open(i, dates))))
    sums = second.agg(*(F.expr(f"named_struct({', '.join(f'{k!r}, {x}' for k, x in facts(i, dates).items())})").alias(f"f{i}") for i in columns))
    row = sums.selectExpr(*(f"struct({verdict(f'f{i}.')} AS name, {numeric(f'f{i}.')} AS decimal, coalesce(f{i}.formats, 0) AS formats) AS v{i}" for i in columns)).first()
    return {f.name: ("BOOLEAN", "", 0) if isinstance(f.dataType, T.BooleanType) and row[i]["name"] != "TEXT" else tuple(row[i]) for i, f in enumerate(df.schema)}


def _all_told(df: DataFrame) -> dict[str, tuple[str, str, int]]:
    """Column name to type name, Spark's type of a NUMERIC one, and formats. One pass over all columns, and one over those that
    may be dates alone; the driver gets a row of each."""
    found = _told_of(df, False)
    dated = [c for c, x in found.items() if x[0] == "TIMESTAMP"]
    return found | (_told_of(df.select(*(quoted(c) for c in dated)), True) if dated else {})


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column name to type name."""
    return {c: x[0] for c, x in _all_told(df).items()}


def inferred_table(df: DataFrame) -> DataFrame:
    """column_name, inferred_type: one row for each column."""
    return df.sparkSession.createDataFrame(list(infer_types(df).items()), "column_name string, inferred_type string")


def cast_typed(df: DataFrame) -> DataFrame:
    """df with each column cast to its inferred type; what does not parse is null."""
    return df.select(*(F.expr(as_type(quoted(c), *x)).alias(c) for c, x in _all_told(df).items()))


def simple_typed(df: DataFrame) -> DataFrame:
    """Whole numbers as int, fractions as decimal(12,2), the rest as text."""
    kinds = {T.LongType: "int", T.IntegerType: "int", T.ShortType: "int", T.DoubleType: "decimal(12,2)", T.FloatType: "decimal(12,2)"}
    return df.select(*(F.col(f"`{f.name}`").try_cast(kinds.get(type(f.dataType), "string")).alias(f.name) for f in df.schema))


def profile(df: DataFrame) -> DataFrame:
    """row_count, column_count, columns (comma-joined), data_types (JSON text, name to type) of df: one row."""
    types = json.dumps({f.name: f.dataType.simpleString() for f in df.schema}, separators=(",", ":"))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", F.lit(len(df.columns)).alias("column_count"), F.lit(",".join(df.columns)).alias("columns"), F.lit(types).alias("data_types"))
