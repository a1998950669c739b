"""Cleaning of untyped frames. Names are handled in the schema, values in one projection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.text import trimmed

#: Texts that stand for null, compared exactly.
NULL_TOKENS = ("nan", "NaN", "NA", "N/A", "null", "NULL", "None", "")


def clean_name(name: str) -> str:
    out = re.sub(r"[^\w\s]", "_", str(name).strip())
    out = re.sub(r"\s+", "_", out).strip("_")
    if out[:1].isdigit():
        out = f"col_{out}"
    return out.lower() or "unnamed_column"


def numbered(names: list[str], first: int = 1) -> list[str]:
    """Repeated names get a suffix: _<first> for the second, and so on."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        n = seen.get(name, 0)
        seen[name] = n + 1
        out.append(f"{name}_{n - 1 + first}" if n else name)
    return out


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*numbered([clean_name(c) for c in df.columns]))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def _strings(df: DataFrame, change) -> DataFrame:
    return df.select(*(change(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))


def trim_all(df: DataFrame) -> DataFrame:
    return _strings(df, trimmed)


def null_tokens(df: DataFrame) -> DataFrame:
    return _strings(df, lambda c: F.when(c.isin(*NULL_TOKENS), None).otherwise(c))


def null_blanks(df: DataFrame) -> DataFrame:
    return _strings(df, lambda c: F.when(c.rlike(r"^\s*$"), None).otherwise(c))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null in every row: one aggregate, of which the driver gets a row."""
    counts = df.agg(*(F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns))).first()
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if counts[i]))


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))


def clean_frame(df: DataFrame) -> DataFrame:
    """Names, rows without values, white space, null tokens: in that order."""
    return df.transform(clean_names).transform(drop_empty_rows).transform(trim_all).transform(null_tokens)


def complex_to_json(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema))


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns named by their path with dots; lists stay whole."""

    def walk(schema: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))
        return out

    return df.select(*walk(df.schema, ()))
