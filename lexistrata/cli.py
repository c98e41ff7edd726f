"""Command line: each command reads files, runs one operator and writes its result."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lexistrata.operators import clusters as c
from lexistrata.operators import flatten as f
from lexistrata.operators.harvest import fetch_harvest
from lexistrata.operators.mapping import suggest_fields
from lexistrata.operators.resources import profile_resources
from lexistrata.operators.terms import profile_terms
from lexistrata.operators.validation import validation_sample
from lexistrata.plans import reports
from lexistrata.sources import catalog, records

METHODS = ["embedding", "fuzzy", "hybrid", "tfidf"]


class UsageError(Exception):
    """An error of the caller with its exit code."""

    def __init__(self, message: str, code: int = 1) -> None:
        super().__init__(message)
        self.code = code


def _session() -> SparkSession:
    return (
        SparkSession.builder.appName("lexistrata")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def _one_file(df: DataFrame, out: Path) -> int:
    """One CSV file; the results written so are small tables of the feature."""
    out.parent.mkdir(parents=True, exist_ok=True)
    folder = f"{out}.parts"
    records.write_csv(df, folder)
    parts = sorted(Path(folder).glob("part-*.csv"))
    if parts:
        parts[0].replace(out)
        for part in Path(folder).iterdir():
            part.unlink()
        Path(folder).rmdir()
    else:
        out.write_text(",".join(n for n in df.columns if n != "ord") + "\n", encoding="utf-8")
    return df.sparkSession.read.csv(str(out), header=True, multiLine=True, escape='"').count()


def _need(*paths: Path | None) -> None:
    for path in paths:
        if path is not None and not path.exists():
            raise UsageError(f"Input file does not exist: {path}")


def _terms(spark: SparkSession, path: Path) -> DataFrame:
    return records.with_counts(records.read_csv(spark, str(path)), "count", "cluster_id")


def fetch(a: argparse.Namespace) -> str:
    a.out.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with a.out.open("w", encoding="utf-8") as out:
        # What came before a page that fails is kept, as the stage promises, and the failure is told.
        pages = catalog.search_pages(
            a.endpoint, a.query, rows=a.rows, per_page=a.per_page, sleep=a.sleep, get=a.transport, partial=True,
            failed=lambda why: print(f"Stopped after {n} records: {why}", file=sys.stderr),
        )
        for results, _ in pages:
            for result in results:
                out.write(json.dumps(catalog.canonical_record(result), ensure_ascii=False) + "\n")
                n += 1
    if not n:
        raise UsageError("No records were fetched. Check the endpoint or the query.")
    return f"Wrote {n} records to {a.out}"


def harvest(a: argparse.Namespace) -> str:
    _need(a.input)
    a.out_dir.mkdir(parents=True, exist_ok=True)
    rows = records.read_records(_session(), str(a.input))
    index = fetch_harvest(rows, str(a.out_dir), limit=a.limit, sleep=a.sleep, transformed=a.transformed, get=a.transport).cache()
    return f"Wrote harvest index with {_one_file(index, a.index_out)} rows"


def flatten(a: argparse.Namespace) -> str:
    _need(a.input)
    flat = f.flatten_records(records.read_records(_session(), str(a.input)), "record", "ord").orderBy("ord")
    return f"Wrote {_one_file(flat, a.out)} flattened records to {a.out}"


def flatten_distributions(a: argparse.Namespace) -> str:
    _need(a.input)
    flat = f.flatten_distributions(records.read_records(_session(), str(a.input)), "record", "ord").orderBy("ord", "distribution_index")
    return f"Wrote {_one_file(flat, a.out)} flattened distributions to {a.out}"


def terms(a: argparse.Namespace) -> str:
    if a.metadata is None:
        raise UsageError("Missing option '--metadata' (or '--input').", 2)
    _need(a.metadata, a.distributions)
    spark = _session()
    more = records.read_csv(spark, str(a.distributions)) if a.distributions else None
    table = profile_terms(records.read_csv(spark, str(a.metadata)), more)
    return f"Wrote {_one_file(table, a.out)} term rows to {a.out}"


def cluster(a: argparse.Namespace) -> str:
    if a.method not in METHODS:
        raise UsageError(f"method must be one of: {', '.join(METHODS)}", 2)
    _need(a.input, a.vectors)
    spark = _session()
    vectors = spark.read.parquet(str(a.vectors)) if a.vectors else None
    table = c.cluster_terms(
        _terms(spark, a.input), method=a.method, min_count=a.min_count, threshold=a.similarity_threshold, domain=a.domain, vectors=vectors
    ).cache()
    n = _one_file(table, a.out)
    return "\n".join([f"Wrote {n} cluster rows to {a.out}", *c.format_metrics(c.cluster_metrics(table).first())])


def domain_summary(a: argparse.Namespace) -> str:
    _need(a.terms, a.clusters)
    spark = _session()
    _write(a.out, reports.domain_report(_terms(spark, a.terms), _terms(spark, a.clusters), a.domain))
    return f"Wrote domain summary to {a.out}"


def map_dcat(a: argparse.Namespace) -> str:
    _need(a.input)
    rows = records.read_rows(_session(), str(a.input))
    table = suggest_fields(f.field_examples(rows, "record", "ord"), include_identity=a.include_identity).orderBy("input_field")
    return f"Wrote {_one_file(table, a.out)} mapping suggestions to {a.out}"


def resources(a: argparse.Namespace) -> str:
    _need(a.distributions)
    profiles, manifest = profile_resources(
        records.read_csv(_session(), str(a.distributions)),
        allowed=a.allowed_formats,
        max_files=a.max_files,
        max_file_mb=a.max_file_size_mb,
        timeout=a.timeout,
        allow_zip=a.allow_zip,
        max_zip_mb=a.max_zip_size_mb,
        max_files_per_zip=a.max_files_per_zip,
        get=a.transport,
    )
    if not manifest.isEmpty():
        _one_file(manifest, a.out.parent / "zip_manifest.csv")
    return f"Wrote {_one_file(profiles, a.out)} resource schema profile rows to {a.out}"


def create_sample(a: argparse.Namespace) -> str:
    _need(a.clusters)
    return f"Wrote {_one_file(validation_sample(_terms(_session(), a.clusters), a.sample_size), a.out)} validation rows to {a.out}"


def score(a: argparse.Namespace) -> str:
    _need(a.input)
    _write(a.out, reports.validation_report(records.read_csv(_session(), str(a.input))))
    return f"Wrote validation scores to {a.out}"


def report(a: argparse.Namespace) -> str:
    _need(a.metadata, a.terms, a.clusters)
    spark = _session()
    text = reports.heterogeneity_report(
        records.read_csv(spark, str(a.metadata)),
        _terms(spark, a.terms),
        _terms(spark, a.clusters),
        distributions=records.read_optional_csv(spark, a.distributions and str(a.distributions)),
        profiles=records.read_optional_csv(spark, a.resource_profiles and str(a.resource_profiles)),
        case_study=a.case_study_dataset_id,
    )
    _write(a.out, text)
    return f"Wrote report to {a.out}"


def _write(out: Path, text: str) -> None:
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(text, encoding="utf-8")


def parser() -> argparse.ArgumentParser:
    """All commands with their options and defaults."""
    top = argparse.ArgumentParser(prog="lexistrata", description="Profile the vocabulary and structure of catalog metadata.")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, **options: object) -> None:  # noqa: ANN001
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        for option, default in options.items():
            flags = ["--" + option.replace("_", "-")] + (["--input"] if (name, option) == ("profile-terms", "metadata") else [])
            if isinstance(default, bool):
                sub.add_argument(*flags, dest=option, action=argparse.BooleanOptionalAction, default=default)
            elif default is Path:
                sub.add_argument(*flags, dest=option, type=Path, required=True)
            elif default is None:
                sub.add_argument(*flags, dest=option, type=Path)
            else:
                sub.add_argument(*flags, dest=option, type=type(default), default=default)

    endpoint = os.environ.get("CATALOG_SEARCH_ENDPOINT", "")
    raw, reports_dir, flat = Path("data/raw"), Path("reports"), Path("data/processed")
    add("fetch", fetch, rows=1000, per_page=100, query="*:*", endpoint=endpoint, sleep=0.2, out=raw / "metadata_sample.jsonl")
    add("fetch-catalog", fetch, rows=1000, per_page=100, query="", endpoint=endpoint, sleep=0.2, out=raw / "catalog_search_results.jsonl")
    for name, made, folder, index in (
        ("fetch-harvest-raw", False, "harvest_records", "harvest_raw_index.csv"),
        ("fetch-harvest-transformed", True, "harvest_transformed", "harvest_transformed_index.csv"),
    ):
        add(name, harvest, input=Path, out_dir=raw / folder, limit=100, sleep=0.2, index_out=reports_dir / index, transformed=made)
    add("flatten", flatten, input=Path, out=flat / "metadata_flat.csv")
    add("flatten-distributions", flatten_distributions, input=Path, out=flat / "distributions_flat.csv")
    add("profile-terms", terms, metadata=None, distributions=None, out=reports_dir / "term_frequency.csv")
    add(
        "cluster-terms", cluster, input=Path, out=reports_dir / "semantic_term_clusters.csv", method="hybrid", min_count=2,
        similarity_threshold=0.82, domain="", vectors=None,
    )
    add("domain-summary", domain_summary, terms=Path, clusters=Path, domain="sensor_telemetry", out=Path)
    add("map-dcat", map_dcat, input=Path, out=reports_dir / "dcat_mapping_suggestions.csv", include_identity=False)
    add(
        "profile-resources", resources, distributions=flat / "distributions_flat.csv", out=reports_dir / "resource_schema_profiles.csv",
        allowed_formats="CSV,XLSX", max_files=10, max_file_size_mb=25, timeout=30, allow_zip=False, max_zip_size_mb=50, max_files_per_zip=20,
    )
    add("create-validation-sample", create_sample, clusters=reports_dir / "semantic_term_clusters.csv", out=reports_dir / "manual_validation_sample.csv", sample_size=100)
    add("score-validation", score, input=Path, out=reports_dir / "manual_validation_scores.md")
    add(
        "report", report, metadata=Path, terms=Path, clusters=Path, distributions=None, resource_profiles=None, case_study_dataset_id="",
        out=reports_dir / "metadata_heterogeneity_report.md",
    )
    return top


def main(argv: list[str] | None = None, transport: catalog.Transport | None = None) -> int:
    """Run a command; the exit code is 0, 1 for missing input or no result, 2 for wrong options."""
    arguments = parser().parse_args(argv)
    arguments.transport = transport or catalog.http_get
    try:
        print(arguments.run(arguments))
    except UsageError as error:
        print(error, file=sys.stderr)
        return error.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
