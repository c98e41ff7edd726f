"""Fetching the harvested originals that catalog records point to, with an index of what came."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.operators.flatten import first_text
from lexistrata.operators.nested import member
from lexistrata.sources.transport import Transport, http_get, safe_name

INDEX = "dataset_id string, title string, harvest_record_raw_url string, content_type string, local_file string, parse_status string, error string"


def raw_url(record: Column) -> Column:
    """The address of a record's harvested original."""
    return first_text(record, "harvest_record_raw", "harvest_record_raw_url")


def transformed_url(record: Column) -> Column:
    """The address of a record's transformed original, made from the raw one where none is given."""
    given = first_text(record, "harvest_record", "harvest_record_transformed", "harvest_record_transformed_url")
    made = F.replace(F.replace(raw_url(record), F.lit("/raw"), F.lit("/transformed")), F.lit("raw=true"), F.lit("transformed=true"))
    return F.when(given != "", given).otherwise(made)


def payload_kind(content: Column, content_type: Column) -> Column:
    """``suffix, status`` of a payload: by its declared type or first sign, then by whether it is JSON."""
    body = F.try_validate_utf8(content.cast("string"))
    start = F.trim(F.substring(content.cast("string"), 1, 4096))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    claimed = kind.contains("json") | start.rlike(r"^[{\[]")
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    parsed = F.get(F.try_variant_get(whole, "$", "array<variant>"), F.lit(0))
    dataset = F.coalesce(F.try_variant_get(parsed, "$['@type']", "string") == "dcat:Dataset", F.lit(False))
    result = lambda suffix, status: F.struct(F.lit(suffix).alias("suffix"), F.lit(status).alias("status"))
    return (
        F.when(claimed & parsed.isNotNull() & dataset, result(".json", "dcat_json"))
        .when(claimed & parsed.isNotNull(), result(".json", "json"))
        .when(claimed, result(".txt", "text"))
        .when(kind.contains("xml") | start.startswith("<"), result(".xml", "xml"))
        .otherwise(result(".txt", "text"))
    )


def classify_payload(content: bytes, content_type: str) -> tuple[str, str]:
    """``payload_kind`` of one payload in a worker."""
    start, kind = content[:4096].decode("utf-8", "ignore").strip(), content_type.lower()
    if "json" in kind or start[:1] in ("{", "["):
        try:
            data = json.loads(content.decode("utf-8"))
        except ValueError:
            return ".txt", "text"
        dataset = isinstance(data, dict) and data.get("@type") == "dcat:Dataset"
        return ".json", "dcat_json" if dataset else "json"
    return (".xml", "xml") if "xml" in kind or start.startswith("<") else (".txt", "text")


def fetch_harvest(
    records: DataFrame, out_dir: str, *, order: str = "ord", limit: int = 100, sleep: float = 0.2, transformed: bool = False, timeout: int = 30, get: Transport = http_get
) -> DataFrame:
    """Index rows of the first ``limit`` records; payloads are written to ``out_dir``, a folder all executors share.

    One task fetches one address after the other, with a pause: the limit is the feature. A record without an address is
    skipped, one that fails says why. A null or odd ``dcat`` member is taken as missing.
    """
    r = F.col("record")
    rows = records.orderBy(order).limit(limit).select(
        F.col(order).alias("_o"),
        first_text(r, "id", "identifier").alias("dataset_id"),
        F.coalesce(F.nullif(first_text(r, "title"), F.lit("")), first_text(member(r, "dcat"), "title")).alias("title"),
        (transformed_url(r) if transformed else raw_url(r)).alias("url"),
    )
    nothing = "no transformed harvest URL found" if transformed else "no harvest_record_raw URL found"
    names = [part.split()[0] for part in INDEX.split(", ")]

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.sort_values("_o").to_dict("records"):
                entry = dict.fromkeys(names, "") | {"dataset_id": row["dataset_id"], "title": row["title"], "harvest_record_raw_url": row["url"]}
                if not row["url"]:
                    out.append(entry | {"parse_status": "skipped", "error": nothing})
                    continue
                try:
                    content, kind = get(row["url"], timeout, 1 << 62)
                    suffix, status = classify_payload(content, kind)
                    path = f"{out_dir}/{safe_name(row['dataset_id'] or row['title'] or 'record')}{suffix}"
                    with open(path, "wb") as file:
                        file.write(content)
                    out.append(entry | {"content_type": kind, "local_file": path, "parse_status": status})
                except Exception as error:  # noqa: BLE001 - the index says what went wrong
                    out.append(entry | {"parse_status": "error", "error": str(error)})
                time.sleep(sleep)
            yield pd.DataFrame(out, columns=names)

    return rows.coalesce(1).sortWithinPartitions("_o").mapInPandas(fetch, INDEX)
