"""Records of any shape as columns: a field that holds an object here and a number there gives columns for both.

Records are VARIANT values. Their common schema is one aggregate; where it cannot say more than VARIANT, because shapes are mixed,
the objects and the other values under that path are asked again by themselves, all such paths of a level in one pass. The
driver gets schemas, not records.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = tuple[str, ...]


def json_path(path: Path) -> str:
    """A path of keys as Spark's variant functions want it. Keys with quotes of both kinds have no such path."""
    return "$" + "".join(f'["{k}"]' if '"' not in k else f"['{k}']" for k in path)


def at(record: str, path: Path, kind: str = "variant") -> Column:
    return F.try_variant_get(F.col(record), json_path(path), kind) if path else F.col(record)


def _type(schema: str | None) -> T.DataType:
    """Spark's type for the text of schema_of_variant_agg."""
    return T._parse_datatype_string(re.sub(r"\bOBJECT<", "STRUCT<", schema)) if schema else T.NullType()


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT<")


def record_columns(records: DataFrame, record: str = "record") -> dict[Path, str]:
    """Every path that holds something other than an object, with the type of what it holds, in the order of the schema."""
    found: dict[Path, str] = {}
    asked: list[Path] = [()]
    while asked:
        values = [at(record, p) for p in asked]
        objects = [F.schema_of_variant_agg(F.when(_is_object(x), x)).alias(f"o{i}") for i, x in enumerate(values)]
        others = [F.schema_of_variant_agg(F.when(~_is_object(x), x)).alias(f"x{i}") for i, x in enumerate(values)]
        row = records.agg(*objects, *others).first()
        mixed: list[Path] = []

        def walk(path: Path, kind: T.DataType) -> None:
            if isinstance(kind, T.StructType):
                for f in kind:
                    walk((*path, f.name), f.dataType)
            elif isinstance(kind, T.VariantType):
                mixed.append(path)
            elif path and path not in asked:
                found[path] = _held(kind)

        for i, path in enumerate(asked):
            other = _type(row[f"x{i}"])
            if path and not isinstance(other, T.NullType):
                found[path] = _held(other)
            walk(path, _type(row[f"o{i}"]))
        asked = mixed
    return found


def _held(kind: T.DataType) -> str:
    """What a column of that type is: text for what has no one type, JSON text for lists of it."""
    text = kind.simpleString()
    return "string" if isinstance(kind, (T.VariantType, T.NullType)) or "variant" in text or "void" in text or "struct" in text else text


def flattened_records(records: DataFrame, record: str = "record") -> DataFrame:
    """A column for each path, named by its keys with dots. Lists stay whole: as arrays where their members have one plain type, else as JSON text."""
    out = []
    for path, kind in record_columns(records, record).items():
        value = at(record, path)
        if kind == "string":
            plain = F.when(F.schema_of_variant(value) == "STRING", at(record, path, "string")).when(F.schema_of_variant(value) != "VOID", F.to_json(value))
            column = F.when(~_is_object(value), plain)
        else:
            column = at(record, path, kind)
        out.append(column.alias(".".join(path)))
    return records.select(*out)
