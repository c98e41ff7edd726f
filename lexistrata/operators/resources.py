"""Schema profiles of downloadable resources: which files can be read, what columns they have and what these mean."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.constants import ZIP_SKIPPED, ZIP_SUPPORTED
from lexistrata.engine import checkpoint, text_or_empty
from lexistrata.functions.text import SEPARATOR
from lexistrata.operators.roles import score_roles
from lexistrata.sources import archives
from lexistrata.sources.transport import Transport, http_get, load

FROM_DISTRIBUTION = ["dataset_id", "dataset_title", "distribution_title"]
#: Columns of a profile after those of the distribution; the role columns list fields of these roles.
ROLE_COLUMNS = {
    "inferred_time_fields": ["time_field", "date_field"],
    "inferred_geo_fields": ["location_field", "latitude_field", "longitude_field", "geometry_field"],
    "inferred_id_fields": ["entity_id_field"],
    "inferred_category_fields": ["category_field"],
    "inferred_status_fields": ["status_field"],
    "inferred_metric_fields": ["metric_field", "count_field", "percentage_field"],
}
_SHEETS = (
    "dataset_id string, dataset_title string, distribution_title string, resource_url string, local_file string, file_type string, "
    "sheet_name string, row_count_estimate int, column_count int, detected_header_row int, columns array<string>, "
    "samples array<array<string>>, notes string, errors string, ord long, part int, "
    "manifest array<struct<zip_url:string,zip_local_file:string,inner_file_name:string,inner_file_extension:string,"
    "inner_file_size_bytes:long,selected_for_schema_profile:boolean,skip_reason:string>>"
)
_NAMES = (
    "dataset_id dataset_title distribution_title resource_url local_file file_type sheet_name row_count_estimate column_count "
    "detected_header_row columns samples notes errors ord part manifest"
).split()


def resource_url(df: DataFrame) -> Column:
    """The download address, else the access address."""
    return F.coalesce(F.nullif(text_or_empty(df, "downloadURL"), F.lit("")), text_or_empty(df, "accessURL"))


def file_type(df: DataFrame, allowed: str = "CSV,XLSX") -> Column:
    """CSV, XLSX or ZIP by format, media type or address, or null; archives are told even where not allowed."""
    kinds = {part.strip().upper() for part in allowed.split(",") if part.strip()}
    form, media, url = F.upper(text_or_empty(df, "format")), F.lower(text_or_empty(df, "mediaType")), F.lower(resource_url(df))
    is_csv = form.contains("CSV") | media.contains("text/csv") | url.endswith(".csv")
    is_xlsx = form.contains("XLSX") | media.contains("spreadsheet") | url.endswith(".xlsx")
    is_zip = form.contains("ZIP") | media.contains("application/zip") | url.endswith(".zip")
    return F.when(F.lit("CSV" in kinds) & is_csv, "CSV").when(F.lit("XLSX" in kinds) & is_xlsx, "XLSX").when(is_zip, "ZIP")


def zip_skip_reason(name: Column, size: Column, most_bytes: int) -> Column:
    """Why an archive member is not profiled, as a built-in expression; empty for one that may be."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    ending = F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]+)$", 1))
    return (
        F.when(path.rlike(r"^/|(^|/)\.\.(/|$)|^[A-Za-z]:"), "unsafe_path")
        .when(ending.isin(ZIP_SKIPPED), "skipped_extension")
        .when(~ending.isin(ZIP_SUPPORTED), "unsupported_extension")
        .when(size > most_bytes, "inner_file_too_large")
        .otherwise("")
    )


def header_rows(cells: DataFrame) -> DataFrame:
    """``table, header_row``: the row of each table's first ten that is filled most, letters counting twice, first of equals.

    ``cells`` has ``table, row, value``.
    """
    value = F.trim(F.coalesce("value", F.lit("")))
    score = F.sum(F.when(value != "", 1).otherwise(0) + F.when(value.rlike("[A-Za-z]"), 1).otherwise(0))
    rows = cells.where(F.col("row") < archives.HEADER_ROWS).groupBy("table", "row").agg(score.alias("score"))
    return rows.groupBy("table").agg(F.max_by("row", F.struct("score", (-F.col("row")).alias("r"))).alias("header_row"))


def eligible(distributions: DataFrame, *, allowed: str, max_files: int, order: str) -> DataFrame:
    """The first distributions that name a readable file and an address."""
    told = distributions.select(
        F.col(order).alias("ord"), *(text_or_empty(distributions, c).alias(c) for c in FROM_DISTRIBUTION),
        resource_url(distributions).alias("resource_url"), file_type(distributions, allowed).alias("file_type"),
    )
    return told.where(F.col("file_type").isNotNull() & (F.col("resource_url") != "")).orderBy("ord").limit(max_files)


def _sheet(base: dict, sheet: str, rows: list, header: int) -> dict:
    names = [(c or f"Unnamed: {i}").strip() for i, c in enumerate(rows[header])] if rows else []
    body = [row for row in rows[header + 1 :] if any(c is not None for c in row)][: archives.ROWS]
    samples = [[row[i] for row in body[:50] if i < len(row) and row[i] is not None and row[i].strip()] for i in range(len(names))]
    return base | {
        "sheet_name": sheet,
        "row_count_estimate": len(body),
        "column_count": len(names),
        "detected_header_row": header,
        "columns": names,
        "samples": samples,
        "notes": "schema profile generated from opt-in resource sample",
    }


def _tables(base: dict, data: bytes, kind: str) -> list[dict]:
    if kind == "CSV":
        return [_sheet(base, "", archives.csv_table(data), 0)]
    sheets = archives.xlsx_sheets(data)
    return [_sheet(base, name, rows, archives.header_row(rows)) for name, rows in sheets]


def _profiler(allow_zip: bool, most_bytes: int, most_zip: int, most_inner: int, timeout: int, get: Transport) -> Callable:
    def one(row: dict) -> list[dict]:
        base = {name: None for name in _NAMES} | {k: row[k] for k in (*FROM_DISTRIBUTION, "resource_url", "file_type", "ord")}
        base |= {"local_file": "", "sheet_name": "", "notes": "", "errors": "", "columns": [], "samples": [], "manifest": []}
        is_zip = row["file_type"] == "ZIP"
        if is_zip and not allow_zip:
            return [base | {"errors": "skipped_zip_allow_zip_false"}]
        try:
            data, place = load(row["resource_url"], timeout=timeout, most_bytes=most_zip if is_zip else most_bytes, get=get)
            base["local_file"] = place
            if not is_zip:
                return _tables(base, data, row["file_type"])
            entries, error = archives.zip_members(data, most_files=most_inner, most_bytes=most_bytes)
            listed = [{k: v for k, v in e.items() if k != "data"} | {"zip_url": row["resource_url"], "zip_local_file": place} for e in entries]
            found = [
                table
                for e in entries
                if e["data"] is not None
                for table in _tables(base | {"file_type": e["inner_file_extension"][1:].upper()}, e["data"], e["inner_file_extension"][1:].upper())
            ] or [base | {"errors": error or "zip_manifest_created_no_schema_profile"}]
            return [found[0] | {"manifest": listed}, *found[1:]]
        except Exception as error:  # noqa: BLE001 - a resource that fails is a row that says so
            said = str(error)
            reason = "zip_too_large" if "exceeds" in said else said or "zip_error"
            note = archives._note(reason) | {"zip_url": row["resource_url"], "zip_local_file": ""}
            note.pop("data")
            return [base | {"errors": said, "manifest": [note] if is_zip else []}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                tables = [t | {"part": i} for i, t in enumerate(one(row))]
                frame = pd.DataFrame(tables, columns=_NAMES)
                for count in ("row_count_estimate", "column_count", "detected_header_row", "part"):
                    frame[count] = frame[count].astype("Int32")
                yield frame

    return run


def profile_resources(
    distributions: DataFrame,
    *,
    order: str = "ord",
    allowed: str = "CSV,XLSX",
    max_files: int = 10,
    max_file_mb: int = 25,
    timeout: int = 30,
    allow_zip: bool = False,
    max_zip_mb: int = 50,
    max_files_per_zip: int = 20,
    get: Transport = http_get,
) -> tuple[DataFrame, DataFrame]:
    """``(profiles, manifest)``: 19 columns for each sheet of each resource, 10 for each member of each archive.

    The limits are the feature: a bounded, opt-in sample of files and of their first rows. A file that cannot be read is
    a row with its error; counts of such rows are null. Files are spread over tasks, one at a time in each.
    """
    chosen = eligible(distributions, allowed=allowed, max_files=max_files, order=order).repartition(max_files, "ord")
    work = _profiler(allow_zip, max_file_mb << 20, max_zip_mb << 20, max_files_per_zip, timeout, get)
    sheets = checkpoint(chosen.mapInPandas(work, _SHEETS))
    keys = ["ord", "part"]
    cells = sheets.select(*keys, F.explode(F.arrays_zip("columns", "samples")).alias("c"))
    roles = _roles(cells.select(*keys, F.col("c.columns").alias("field_name"), F.col("c.samples").alias("values")), keys)
    joined = sheets.join(roles, keys, "left").orderBy(*keys)
    profile = joined.select(
        *FROM_DISTRIBUTION, "resource_url", "local_file", "file_type", "sheet_name", "row_count_estimate", "column_count", "detected_header_row",
        F.array_join("columns", SEPARATOR).alias("detected_columns"),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ROLE_COLUMNS), "notes", "errors",
    )
    manifest = sheets.select(*keys, *FROM_DISTRIBUTION, F.posexplode("manifest").alias("_m", "x")).orderBy(*keys, "_m")
    return profile, manifest.select(*FROM_DISTRIBUTION, "x.*")


def _roles(named: DataFrame, keys: list[str]) -> DataFrame:
    scored = score_roles(named, keys).where("confidence >= 0.5")
    listed = scored.groupBy(*keys, "inferred_role").agg(
        F.array_join(F.array_sort(F.collect_list("field_name")), SEPARATOR).alias("fields")
    )
    columns = []
    for name, roles in ROLE_COLUMNS.items():
        parts = [F.max(F.when(F.col("inferred_role") == role, F.col("fields"))) for role in roles]
        whole = F.coalesce(*parts) if name == "inferred_time_fields" else F.concat_ws(SEPARATOR, *parts)
        columns.append(whole.alias(name))
    return listed.groupBy(*keys).agg(*columns)


def count_by_type(distributions: DataFrame, allowed: str = "CSV,XLSX") -> DataFrame:
    """``file_type, n``: how many distributions could be profiled as each type."""
    return distributions.select(F.coalesce(file_type(distributions, allowed), F.lit("")).alias("file_type")).groupBy("file_type").agg(
        F.count("*").alias("n")
    )
