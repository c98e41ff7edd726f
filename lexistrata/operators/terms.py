"""Term frequencies of flat metadata, with bounded examples.

Cells become terms inside one projection; counts are combined before the shuffle. Examples are the first five distinct
records of a term: each task keeps what can be among them, in numbers, before rows are moved, so that a term found
everywhere never gathers its records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistrata.constants import COMPOUND_FIELDS, TERM_COLUMNS, TERM_FIELDS
from lexistrata.engine import stored, text_or_empty
from lexistrata.functions.text import SEPARATOR, list_terms, phrases, without_stopwords

EXAMPLES = 5
#: Rows of a task that are looked through at once for examples.
BATCH_ROWS = 1 << 21


def term_rows(df: DataFrame, order: str) -> DataFrame:
    """``ord, pos, id, title, source_field, term, normalized_term``: one row for each term of each cell.

    Columns of ``TERM_FIELDS`` that ``df`` lacks hold nothing. ``order`` names a column that orders the records.
    """
    cells = [
        F.struct(F.lit(field).alias("field"), F.lit(i).alias("place"), text_or_empty(df, field).alias("value"))
        for i, field in enumerate(TERM_FIELDS)
        if field in df.columns
    ]
    none = F.array().cast("array<struct<field:string,place:int,value:string>>")
    base = df.select(
        F.col(order).alias("ord"), text_or_empty(df, "id").alias("_i"), text_or_empty(df, "title").alias("_t"), F.concat(none, F.array(*cells)).alias("_c")
    )
    # One row a cell first, so that what makes terms of it stands in the plan once, not once for each field.
    filled = base.select("ord", "_i", "_t", F.explode("_c").alias("c")).where("c.value <> ''")
    listed = F.col("c.field").isin(COMPOUND_FIELDS)
    found = F.when(listed, list_terms(F.col("c.value"))).otherwise(phrases(F.col("c.value")))
    exploded = filled.select("ord", "_i", "_t", "c.field", "c.place", F.posexplode(found).alias("at", "term"))
    rows = exploded.select(
        "ord",
        (F.col("place").cast("long") * 10_000_000 + F.col("at")).alias("pos"),
        F.col("_i").alias("id"),
        F.col("_t").alias("title"),
        F.col("field").alias("source_field"),
        "term",
        without_stopwords(F.col("term")).alias("normalized_term"),
    )
    return rows.where("normalized_term <> ''")


def distribution_metadata(distributions: DataFrame) -> DataFrame:
    """Distribution rows as metadata rows, so that their titles, formats and descriptions are counted as well."""
    names = {
        "id": "dataset_id",
        "title": "dataset_title",
        "distribution_titles": "distribution_title",
        "distribution_formats": "format",
        "distribution_media_types": "mediaType",
        "notes": "distribution_description",
    }
    return distributions.select("*", *(text_or_empty(distributions, old).alias(new) for new, old in names.items() if new not in distributions.columns))


def count_terms(rows: DataFrame) -> DataFrame:
    """``term, normalized_term, source_field, count, ord``: how often each term occurs in each field."""
    return rows.groupBy("term", "normalized_term", "source_field").agg(
        F.count("*").alias("count"), F.min(F.struct("ord", "pos")).alias("ord")
    )


def _first_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of some million rows each, those that have one of the first distinct ids or titles of their key.

    A value that is among the first of all rows is so among the first of any part that has its first row.
    """

    def chosen(k: np.ndarray, ord_: np.ndarray, pos: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(value)
        at = at[np.lexsort((pos[at], ord_[at], value[at], k[at]))]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (k[at[1:]] != k[at[:-1]]) | (value[at[1:]] != value[at[:-1]])
        at = at[new]
        at = at[np.lexsort((pos[at], ord_[at], k[at]))]
        starts = np.ones(len(at), dtype=bool)
        starts[1:] = k[at[1:]] != k[at[:-1]]
        places = np.arange(len(at))
        return at[places - np.maximum.accumulate(np.where(starts, places, 0)) < EXAMPLES]

    def kept(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        k, ord_, pos, ids, titles = (c.to_numpy() for c in rows.columns)
        at = np.union1d(chosen(k, ord_, pos, ids), chosen(k, ord_, pos, titles))
        yield from rows.take(pa.array(at)).to_batches()

    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= BATCH_ROWS:
            yield from kept(parts)
            parts, n = [], 0
    if parts:
        yield from kept(parts)


def _code(value: str) -> Column:
    """A number for a text, 0 for a blank one."""
    return F.when(F.trim(F.col(value)) != "", F.xxhash64(F.trim(F.col(value)))).otherwise(F.lit(0).cast("long"))


def _examples(rows: DataFrame, records: DataFrame, keys: DataFrame | None, names: dict[str, str]) -> DataFrame:
    """``key`` and columns named by ``names`` of the first distinct values of ``id`` or ``title``, in one cell.

    ``rows`` has ``key, ord, pos, id, title``, and ``records`` has ``ord, id, title`` for every ``ord``. Only numbers are
    moved before the first rows of a key are known: texts are put in for those. ``keys``, if given, has the keys asked for.
    """
    shape = "key long, ord long, pos long, id long, title long"
    numbers = rows.select("key", F.col("ord").cast("long").alias("ord"), F.col("pos").cast("long").alias("pos"), _code("id").alias("id"), _code("title").alias("title"))
    firsts = numbers.mapInArrow(_first_of_batch, shape).repartition("key")
    if keys is not None:
        firsts = firsts.join(keys, "key", "left_semi")

    def ranked(value: str) -> DataFrame:
        once = firsts.where(F.col(value) != 0).groupBy("key", value).agg(F.min(F.struct("ord", "pos")).alias("at"))
        rank = Window.partitionBy("key").orderBy("at")
        return once.select("key", F.col("at.ord").alias("ord"), F.lit(value).alias("which"), F.col(value).alias("code"), F.row_number().over(rank).alias("n")).where(F.col("n") <= EXAMPLES)

    asked = reduce(DataFrame.unionByName, map(ranked, names))
    texts = records.select("ord", *(F.trim(F.col(value)).alias(value) for value in names))
    text = F.coalesce(*(F.when(F.col("which") == value, F.col(value)) for value in names))
    told = asked.join(texts, "ord").select("key", "which", "n", "code", text.alias("v")).where(F.xxhash64("v") == F.col("code"))
    cells = (
        F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("which") == value, F.struct("n", "v")))), lambda x: x["v"]), SEPARATOR).alias(name)
        for value, name in names.items()
    )
    return told.groupBy("key").agg(*cells)


def profile_terms(
    metadata: DataFrame,
    distributions: DataFrame | None = None,
    *,
    order: str = "ord",
    examples: tuple[str, ...] = ("id", "title"),
    keep: Callable[[DataFrame], DataFrame] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """The term table: six columns and ``ord``, ordered by count and term.

    Distribution rows carry the dataset's title, whose terms are so counted once more for each distribution. Empty
    tables give an empty table; rows without words give no terms. ``examples`` tells which examples are wanted, ``keep``
    filters the counted terms before examples are sought.
    """
    names = {value: f"example_{'record_ids' if value == 'id' else 'titles'}" for value in examples}
    sources = [metadata]
    if distributions is not None:
        last = metadata.agg(F.max(order)).first()[0]
        sources.append(distribution_metadata(distributions).withColumn(order, F.col(order) + F.lit((last or 0) + 1)))
    rows = reduce(DataFrame.unionByName, (term_rows(source, order) for source in sources))
    counted = count_terms(rows)
    if keep:
        counted = keep(counted)
    if names:
        keys = F.xxhash64("term", "normalized_term", "source_field").alias("key")
        counted = stored(counted.select(keys, "*"))
        records = reduce(
            DataFrame.unionByName, (s.select(F.col(order).alias("ord"), *(text_or_empty(s, v).alias(v) for v in ("id", "title"))).distinct() for s in sources)
        )
        found = _examples(rows.select(keys, "ord", "pos", "id", "title"), records, counted.select("key") if keep else None, names)
        counted = counted.join(found, "key", "left")
    filled = counted.select(
        "term", "normalized_term", "source_field", "count", *(text_or_empty(counted, name).alias(name) for name in TERM_COLUMNS[4:]), "ord"
    )
    return filled.orderBy(F.desc("count"), "normalized_term", "ord") if ordered else filled
