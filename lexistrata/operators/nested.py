"""Nested records into related flat tables.

A merged schema of a JSON column is inferred in one pass with per-task counts of (path, kind). Every list path of that
schema becomes a child table whose rows carry the keys of the source row, the ordinals of all enclosing lists (the
parent's surrogate key) and their own ordinal. Struct columns are shredded the same way from their declared schema.
The explosion itself is JVM-side (``posexplode`` over VARIANT or array columns): no group is gathered, nothing shuffles.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "[]"


def _kind(value: object) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return "null" if value is None else "scalar"


def _reject(constant: str) -> None:
    raise ValueError(constant)


def _walk(value: object, path: str, seen: Counter, maps: frozenset[str]) -> None:
    stack = [(value, path)]
    while stack:
        node, at = stack.pop()
        seen[at, _kind(node)] += 1
        if isinstance(node, dict):
            if at.rpartition(".")[2] not in maps:
                stack += [(child, f"{at}.{name}" if at else name) for name, child in node.items()]
        elif isinstance(node, list):
            stack += [(child, at + ITEM) for child in node]


def merged_schema(df: DataFrame, payload: str, *, maps: Sequence[str] = ()) -> DataFrame:
    """Every path of the JSON objects in ``payload`` with the kinds seen there and how often.

    Objects named in ``maps`` hold data as keys and are not descended into. Returns ``path, kind, n``; the list items
    of a path ``a`` are at ``a[]``. Lines that are null or no valid JSON object count for nothing.
    """
    held = frozenset(maps)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for line in batch["_json"]:
                try:
                    value = json.loads(line, parse_constant=_reject) if line else None
                except (ValueError, RecursionError):
                    continue
                if isinstance(value, dict):
                    _walk(value, "", seen, held)
        rows = [(path, kind, n) for (path, kind), n in seen.items()]
        yield pd.DataFrame(rows, columns=["path", "kind", "n"])

    per_task = df.select(F.col(payload).alias("_json")).mapInPandas(count, "path string, kind string, n long")
    return per_task.groupBy("path", "kind").agg(F.sum("n").alias("n"))


def parse_object(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON object, else null.

    The parser stops after the first value; inside brackets and inside an object, anything left over is an error.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    ok = inside.isNotNull() & (F.size(F.try_variant_get(alone, "$", "array<variant>")) == 1)
    value = F.try_variant_get(inside, "$.v", "variant")
    return F.when(ok & is_object(value), value)


def is_object(value: Column) -> Column:
    """Whether a VARIANT is an object; false for null."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def member(value: Column, *names: str) -> Column:
    """A member of a VARIANT object, null where it is missing."""
    steps = "".join(f"['{name}']" for name in names)
    return F.try_variant_get(value, "$" + steps, "variant")


def as_list(value: Column) -> Column:
    """Items of a VARIANT list; one object or scalar counts as a list of one; missing and null have no items."""
    one = F.when(value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(True)), F.array(value))
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), one)


def child_table(df: DataFrame, keys: Sequence[str], doc: str, path: str) -> DataFrame:
    """The items of one list path: ``keys``, ``_parent`` (ordinals of the enclosing lists), ``_ord``, ``_item``.

    ``_single`` tells that one object or scalar stood where a list was expected. ``path`` is written as in ``merged_schema``, its list ends in ``[]``. Ordinals count unusable items too.
    """
    rows = df.select(*keys, F.array().cast("array<int>").alias("_at"), F.col(doc).alias("_item"))
    steps = path.split(ITEM)
    if steps.pop():
        raise ValueError(f"{path} names no list")
    for step in steps:
        names = [name for name in step.split(".") if name]
        inner = member(F.col("_item"), *names) if names else F.col("_item")
        single = F.try_variant_get(inner, "$", "array<variant>").isNull()
        rows = rows.select(
            *keys, "_at", single.alias("_single"), F.posexplode(as_list(inner)).alias("_ord", "_item")
        ).select(*keys, F.concat("_at", F.array("_ord")).alias("_at"), "_single", "_item")
    return rows.select(
        *keys,
        F.slice("_at", 1, F.size("_at") - 1).alias("_parent"),
        F.element_at("_at", -1).alias("_ord"),
        "_single",
        "_item",
    )


def keys_as_list(value: Column) -> Column:
    """The keys of a VARIANT object as a VARIANT list of texts; null for anything else."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.when(is_object(value), F.try_parse_json(F.to_json(keys)))


def child_rows(df: DataFrame, keys: Sequence[str], lists: Mapping[str, Column]) -> DataFrame:
    """The items of several lists of a row in one explosion: ``keys``, ``_path``, ``_ord``, ``_item``.

    ``lists`` names VARIANT expressions; one object or scalar counts as a list of one, null and missing have no items.
    """
    def placed(path: str, value: Column) -> Column:
        return F.transform(
            F.coalesce(as_list(value), F.array().cast("array<variant>")),
            lambda item, i: F.struct(F.lit(path).alias("_path"), i.alias("_ord"), item.alias("_item")),
        )

    every = F.concat(*(placed(path, value) for path, value in lists.items()))
    return df.select(*keys, F.inline(every))


def shred(df: DataFrame, keys: Sequence[str], doc: str, schema: DataFrame) -> dict[str, DataFrame]:
    """A lazy child table for every list of a merged schema, by path.

    A path at which both lists and single objects occur is one table; a single object has ordinal 0. The schema's
    paths are collected: their number is that of the distinct names, not of the rows.
    """
    found = schema.where(F.col("path") != "").groupBy("path").agg(F.collect_set("kind").alias("kinds")).collect()
    lists = sorted(row.path + ITEM for row in found if "array" in row.kinds)
    return {path: child_table(df, keys, doc, path) for path in lists}


def shred_struct(df: DataFrame, keys: Sequence[str], column: str) -> dict[str, DataFrame]:
    """A lazy child table for every array below a struct or array column, by path, from the declared schema."""
    tables: dict[str, DataFrame] = {}

    def descend(rows: DataFrame, kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                descend(
                    rows.select(*keys, "_at", F.col("_item")[field.name].alias("_item")),
                    field.dataType,
                    f"{path}.{field.name}",
                )
        elif isinstance(kind, T.ArrayType):
            items = rows.select(*keys, "_at", F.posexplode("_item").alias("_ord", "_item"))
            tables[path + ITEM] = items.select(*keys, F.col("_at").alias("_parent"), "_ord", "_item")
            descend(
                items.select(*keys, F.concat("_at", F.array("_ord")).alias("_at"), "_item"),
                kind.elementType,
                path + ITEM,
            )

    root = df.select(*keys, F.array().cast("array<int>").alias("_at"), F.col(column).alias("_item"))
    descend(root, df.schema[column].dataType, column)
    return tables
