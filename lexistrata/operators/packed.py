"""Several values packed in one field, one per row with its place.

Ordinary characters are masked, which leaves a skeleton of delimiters, quotes and brackets. The rule to split by is
resolved once for each distinct skeleton and joined back; it is broadcast where the number of skeletons is small (it is
counted), else joined by hash. The splitting itself is a built-in expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint
from lexistrata.functions.cleaning import strip_ends

#: Characters that part values wherever they stand outside quotes.
HARD = ";；|•\n\t"
#: A delimiter counts where an even number of double quotes follows.
OUTSIDE_QUOTES = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
THOUSANDS = r",(?!(?<=\d,)\d{3}(?!\d))"
CODE = r"\d+:\d+"
MOST_BROADCAST = 20_000


def skeleton(item: Column) -> Column:
    """The delimiters, quotes and brackets of a text; ``w`` stands for ordinary text, ``c`` for a code like 001:23."""
    s = strip_ends(item)
    s = F.regexp_replace(s, r"(?<![\w:])\d+:\d+(?![\w:])", "\u0001")
    s = F.regexp_replace(s, r"(?<=\d),(?=\d{3}(?!\d))", "")
    s = F.regexp_replace(s, r'[^\u0001;；|•\n\t,/"\'\[\] ]+', "w")
    s = F.regexp_replace(s, r"w(?:['\[\] ]*w)+(?=[^'\]]|$)", "w")
    s = F.regexp_replace(s, "\u0001", "c")
    # Any number of like values in a row has one skeleton.
    for _ in range(2):
        s = F.regexp_replace(s, r"((?:\"[wc]\"|'[wc]'|[wc]) *(?:[;；|•\n\t,/] *)+)\1+", "$1$1")
    return s


def rule_of(mask: str) -> str | None:
    """The regular expression that parts a text of this skeleton into values, or none."""
    quoted = mask.count('"') % 2 == 0
    body = mask
    if mask.startswith("[") and mask.endswith("]"):
        body = mask[1:-1]
        if re.fullmatch(r"\s*'.*'\s*", body, re.DOTALL):
            return r"(?<=')\s*,\s*(?=')"
    outside = re.sub(r'"[^"]*"', "w", body) if quoted else body
    codes = "c" in outside and "w" not in outside.replace('"c"', "c") or bool(re.fullmatch(r'[^w]*', body)) and "c" in body
    marks = [re.escape(c) for c in HARD if c in outside]
    if "," in outside:
        marks.append("," if codes else THOUSANDS)
    if re.search(r"\s/(?:\s|$)", outside) or codes and "/" in outside:
        marks.append("/" if codes else r"(?<=\s)/(?=\s|$)|/$")
    if codes and re.search(r"c +c", outside):
        marks.append(r"(?<=\d) +(?=\d)")
    if not marks:
        return None
    return "(?:" + "|".join(marks) + ")" + (OUTSIDE_QUOTES if quoted and '"' in mask else "")


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(_rule=batch["_mask"].map(rule_of))


def bare(value: Column) -> Column:
    """A value without outer white space and enclosing quotes or brackets; doubled quotes inside are made single."""
    v = strip_ends(value)
    v = F.when(v.rlike(r'(?s)^".*"$') & (F.length(v) > 1), F.regexp_replace(F.substring(v, 2, F.length(v) - 2), '""', '"')).otherwise(v)
    v = F.when(v.rlike(r"(?s)^'.*'$") & (F.length(v) > 1), F.regexp_replace(F.substring(v, 2, F.length(v) - 2), "''", "'")).otherwise(v)
    v = F.when(v.rlike(r"(?s)^(?:\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\})$"), F.substring(v, 2, F.length(v) - 2)).otherwise(v)
    return strip_ends(v)


def unpack(df: DataFrame, item: str) -> DataFrame:
    """Adds ``_values``, the values of each text of column ``item`` in order, empty ones left out.

    A text of one value yields that value; null and blank texts yield an empty list. Delimiters inside double quotes,
    commas between the digits of a number and slashes without a space before them part nothing; slashes and single
    spaces part codes like ``001:23``. Several kinds of delimiter in one text all part. Unpaired quotes are ordinary
    characters. Other columns stay as they are, repeated rows too; ``_mask``, ``_rule`` and ``_values`` must be free names.
    """
    masked = df.withColumn("_mask", skeleton(F.col(item)))
    some = masked.where(F.col("_mask").rlike(r"[;；|•\n\t,/ ]"))
    rules = checkpoint(some.select("_mask").distinct().mapInPandas(_resolve, "_mask string, _rule string"))
    rules = rules.where(F.col("_rule").isNotNull())
    if rules.count() <= MOST_BROADCAST:
        rules = F.broadcast(rules)
    ruled = masked.join(rules, "_mask", "left")
    text = strip_ends(F.col(item))
    listed = F.regexp_replace(text, r"(?s)^\[(.*)\]$", "$1")
    parts = F.when(F.col("_rule").isNull(), F.array(text)).otherwise(F.split(listed, F.col("_rule")))
    values = F.filter(F.transform(parts, bare), lambda v: F.length(v) > 0)
    return ruled.withColumn("_values", F.coalesce(values, F.array().cast("array<string>"))).drop("_mask", "_rule")
