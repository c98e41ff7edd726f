"""Markdown reports: small aggregates are collected, the text is put together on the driver."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexistrata.constants import SENSOR_EXPANSIONS, SENSOR_PATTERNS
from lexistrata.operators import domain as domains
from lexistrata.operators import profiling as p
from lexistrata.operators.validation import validation_scores


def cell(value: object) -> str:
    """A value in a table cell."""
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(rows: list, columns: list[str], labels: list[str] | None = None) -> str:
    """A table of collected rows."""
    if not rows:
        return "_No rows available._"
    head = ["| " + " | ".join(labels or columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(head + ["| " + " | ".join(cell(row[c]) for c in columns) + " |" for row in rows])


def _values(metadata: DataFrame, column: str) -> str:
    rows = p.top_parts(metadata, column).collect()
    return markdown_table(rows, ["value", "n"], [column, "count"]) if rows else "_No values available._"


def _case(metadata: DataFrame, profiles: DataFrame | None, dataset: str) -> list[str]:
    head = "## Case Study"
    if not dataset:
        return [head, "", "_No case-study dataset id provided._"]
    if "id" not in metadata.columns:
        return [head, "", "_Metadata file has no `id` column._"]
    row = metadata.where(F.col("id").cast("string") == dataset).orderBy("ord").first()
    if row is None:
        return [head, "", f"_No metadata row found for `{dataset}`._"]
    of = row.asDict()
    first = lambda *names: next((of[n] for n in names if n in of), "")
    lines = [
        head,
        "",
        f"- Dataset id: `{dataset}`",
        f"- Title: {first('title')}",
        f"- Description: {first('notes')}",
        f"- Keywords: {first('tags', 'dcat_keyword')}",
        f"- Distributions: {first('distribution_count', 'resources_count')}",
        f"- Resource formats: {first('distribution_formats', 'resource_formats')}",
        "",
        "Metadata tells a dataset's topic, publisher, keywords and links; it does not tell its columns and what they mean.",
    ]
    if profiles is not None and "dataset_id" in profiles.columns:
        for profile in profiles.where(F.col("dataset_id").cast("string") == dataset).limit(5).collect():
            if lines[-1].startswith("Metadata tells"):
                lines += ["", "Resource-level profiling reveals:"]
            roles = " ".join(str(profile[c] or "") for c in profiles.columns if c.startswith("inferred_"))
            lines.append(f"- `{profile['distribution_title']}` columns: {profile['detected_columns']}; roles: {roles}")
    return lines


def heterogeneity_report(
    metadata: DataFrame,
    terms: DataFrame,
    clusters: DataFrame,
    *,
    distributions: DataFrame | None = None,
    profiles: DataFrame | None = None,
    case_study: str = "",
) -> str:
    """The report on how differently a catalog says the same things."""
    total = metadata.agg(F.count("*").alias("n"), p.distinct_filled(metadata, "organization_name").alias("orgs")).first()
    normalized = terms.agg(F.count_distinct("normalized_term")).first()[0]
    examples = [f"- `{cell(r.canonical_term)}` appears as: {cell(r.observed_term)}." for r in p.cluster_examples(clusters).collect()]
    complete = [r.asDict() | {"percent_present": f"{r.percent_present:.1f}%"} for r in p.completeness(metadata).collect()]
    varied: dict[str, list[str]] = {}
    for row in p.heterogeneity(metadata).collect():
        varied.setdefault(row.label, []).append(f"`{row.value}` ({row.n})")
    lines = [
        "# Catalog Metadata Heterogeneity Report",
        "",
        f"Collection date: {datetime.now(UTC).date().isoformat()}",
        "",
        "## Metadata Snapshot Summary",
        "",
        f"- Metadata records analyzed: {total.n}",
        f"- Organizations/publishers represented: {total.orgs}",
        f"- Total distributions/resources: {p.distribution_total(metadata, distributions)}",
        f"- Unique tags/keywords: {p.distinct_parts(metadata, 'tags').first().n}",
        f"- Normalized terms: {normalized}",
    ]
    for title, column in (("Formats", "distribution_formats"), ("Media Types", "distribution_media_types")):
        lines += ["", f"### Top {title}", "", _values(metadata, column)]
    lines += ["", "### Access Level Distribution", "", _values(metadata, "dcat_accessLevel"), "", "## Terminology Heterogeneity"]
    lines += ["", "## Top Duplicate Terms", "", markdown_table(p.top_duplicates(terms).collect(), ["normalized_term", "count", "source_field"])]
    top = ["cluster_id", "canonical_term", "observed_term", "count", "cluster_reason"]
    lines += ["", "## Top Semantic Clusters", "", markdown_table(p.top_clusters(clusters).collect(), top)]
    lines += ["", "## Examples Of Same Concept Expressed Differently", "", "\n".join(examples) or "_No cluster examples available._"]
    shown = ["field", "count_present", "percent_present", "examples_missing"]
    lines += ["", "## DCAT Field Completeness", "", markdown_table(complete, shown)]
    kinds = [f"- {label}: " + ", ".join(values) for label, values in varied.items()]
    lines += ["", "## Distribution-Level Heterogeneity", "", "\n".join(kinds) or "_No distribution fields available._", ""]
    lines += _case(metadata, profiles, case_study)
    lines += [
        "",
        "## Limitations",
        "",
        "- The records describe datasets; the datasets themselves were not read, but for opted-in samples.",
        "- Clusters are evidence of likeness, not proof of it; people have to confirm them.",
        "",
    ]
    return "\n".join(lines)


def domain_report(terms: DataFrame, clusters: DataFrame, domain: str) -> str:
    """The summary of one domain; any but the one known is an error."""
    domains.check_domain(domain)
    counts = {row.label: row.n for row in domains.pattern_counts(terms).collect()}
    noisy = sorted(row.term for row in domains.noisy_terms(terms).collect())
    found = domains.domain_clusters(clusters).collect()
    rows = [r.asDict() | {"observed_terms": r.observed_terms.replace("|", ";")} for r in found]
    table = markdown_table(rows, ["cluster_id", "canonical_term", "observed_terms", "count"]) if rows else "_No sensor/telemetry clusters found._"
    lines = ["# Sensor Telemetry Domain Summary", "", "## Term Counts", ""]
    lines += [f"- {label}: {counts.get(label, 0)}" for label in SENSOR_PATTERNS]
    lines += ["", "## Interpretable Clusters", "", table, "", "## Noisy Terms Detected", ""]
    lines += [", ".join(noisy) or "_No configured noisy terms detected._", "", "## Recommended Semantic Expansion Terms", ""]
    return "\n".join([*lines, ", ".join(SENSOR_EXPANSIONS), ""])


def validation_report(labelled: DataFrame) -> str:
    """Scores of a reviewed sample."""
    row = validation_scores(labelled).first()
    return "\n".join(
        [
            "# Manual Validation Scores",
            "",
            f"- Number reviewed: {row.reviewed}",
            f"- Equivalent: {row.equivalent}",
            f"- Related: {row.related}",
            f"- Not equivalent: {row.not_equivalent}",
            f"- Unsure: {row.unsure}",
            f"- Estimated useful precision: {row.precision:.2%}",
            "",
        ]
    )
