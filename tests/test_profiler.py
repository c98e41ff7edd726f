"""The profiler's stages on small inputs of their own."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexistrata import cli
from lexistrata.constants import CLUSTER_COLUMNS
from lexistrata.functions import similarity
from lexistrata.functions import text as t
from lexistrata.operators import clusters, flatten, mapping, resources, roles, validation
from lexistrata.operators.components import connected_components
from lexistrata.operators.harvest import classify_payload
from lexistrata.sources import archives, catalog, records


def _one(spark, function, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in rows.select(function(F.col("v"))).collect()]


def test_normal_forms(spark):
    assert _one(spark, t.normalize_text, "Road_Safety & Crashes (2024)", "Cañón  ﬁle", "see https://a.example/x now", None, "Tags", "Subject") == [
        "road safety and crashes 2024", "canon file", "see now", "", "tags", "keyword",
    ]
    assert _one(spark, lambda v: t.normalize_text(v, remove_stopwords=True), "the state of the art") == ["state art"]
    assert _one(spark, t.split_compound, "roads; Bridges, rail | ;", ";", None) == [["roads", "bridges", "rail"], [], []]
    assert _one(spark, t.phrases, "red green blue", "one two", "the") == [["red green blue", "red green", "green blue"], ["one two"], []]


def test_term_filters(spark):
    terms = ["ab", "data gov", "2024", "2024 01 02", "8609d096-f28d-3cdb-7d39-31cab5533641", "bridge"]
    assert _one(spark, t.is_excluded, *terms) == [True] * 5 + [False]
    assert _one(spark, t.is_sensor_term, "octet stream", "air sensor", "bridge") == [False, True, False]


def test_token_sets():
    assert similarity.token_set_similarity("road traffic", "traffic road data") == 1.0
    assert similarity.token_set_similarity("", "x") == 0.0
    assert similarity.common_subsequence("topic", "topics") == 5
    assert round(similarity.token_set_similarity("topic", "topics"), 3) == 0.909


def test_components_equal_union_find(spark):
    edges = [("a", "b"), ("c", "b"), ("d", "e"), ("f", "f"), ("e", "d"), *((f"n{i:02}", f"n{i + 1:02}") for i in range(30))]
    nodes = sorted({x for e in edges for x in e} | {"z"})
    got = connected_components(spark.createDataFrame([(n,) for n in nodes], "term string"), spark.createDataFrame(edges, "l string, r string"))
    roots = {r.term: r.root for r in got.collect()}
    assert roots["c"] == roots["b"] == "a" and roots["e"] == "d" and roots["f"] == "f" and roots["z"] == "z"
    assert {roots[f"n{i:02}"] for i in range(31)} == {"n00"}


RECORDS = [
    {"id": "a", "title": "Road crashes", "tags": [{"name": "roads"}, {"display_name": "Crash"}], "extras": [{"key": "keyword", "value": "k1"}, {"key": "keyword", "value": "k2"}],
     "resources": [{"name": "file", "format": "CSV", "downloadURL": "https://x.example/a.csv"}, "odd", {"name": "api", "url": "https://x.example/api"}]},
    {"@type": "dcat:Dataset", "identifier": "b", "title": "Parks", "keyword": ["trees", "trees", "grass"], "publisher": {"name": "City"}, "distribution": {"title": "d", "mediaType": "text/csv", "accessURL": "https://y.example"}},
]


def test_flattening(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in RECORDS) + "\n\n[1]\n", encoding="utf-8")
    rows = records.read_jsonl(spark, str(path))
    one, two = flatten.flatten_records(rows, "record", "ord").orderBy("ord").collect()
    assert len(one.asDict()) - 1 == 48
    assert (one.id, one.tags, one.dcat_keyword, one.resources_count) == ("a", "roads | Crash", "k2", 2)
    assert (two.id, two.tags, two.organization_name, two.dcat_theme, two.distribution_count) == ("b", "trees | grass", "City", "", 1)
    spread = flatten.flatten_distributions(rows, "record").collect()
    assert sorted((r.dataset_id, r.distribution_index, r.accessURL) for r in spread) == [("a", 0, ""), ("a", 2, "https://x.example/api"), ("b", 0, "https://y.example")]
    path.write_text('{"a":1}\n{bad\n', encoding="utf-8")
    with pytest.raises(Exception, match="Invalid JSONL at .*:2"):
        records.read_jsonl(spark, str(path)).collect()
    assert records.read_jsonl(spark, str(path), strict=False).count() == 1


def test_clusters_of_hand_made_terms(spark):
    rows = [("csv", "csv", "f", 5), ("comma separated values", "comma separated values", "f", 3), ("traffic crash", "traffic crash", "t", 4), ("traffic crashes", "traffic crashes", "t", 2), ("bridge", "bridge", "t", 9), ("once", "once", "t", 1)]
    terms = spark.createDataFrame(rows, "term string, normalized_term string, source_field string, count long").withColumn("example_titles", F.lit("x"))
    table = clusters.cluster_terms(terms, method="fuzzy")
    got = {r.normalized_term: (r.cluster_id, r.canonical_term) for r in table.collect()}
    assert table.columns == CLUSTER_COLUMNS and "once" not in got
    assert got["comma separated values"] == got["csv"] and got["csv"][1] == "csv"
    metrics = clusters.cluster_metrics(table).first()
    assert metrics.total_terms == 5 and metrics.largest_cluster_size >= 2 and metrics.warning
    assert clusters.cluster_terms(terms.limit(0)).columns == CLUSTER_COLUMNS
    sample = validation.validation_sample(table, 2)
    assert sample.count() == 2 and sample.first().predicted_equivalent
    labelled = spark.createDataFrame([(" Equivalent",), ("related",), ("unsure",), ("not_equivalent",), ("",), (None,)], "human_label string")
    scores = validation.validation_scores(labelled).first()
    assert (scores.reviewed, scores.precision) == (4, 0.5)


def test_mapping(spark):
    fields = spark.createDataFrame([(f, "") for f in ("Agency", "distribution_file_url", "topic", "title", "zzz")], "input_field string, example_value string")
    got = {r.input_field: (r.suggested_dcat_field, r.confidence) for r in mapping.suggest_fields(fields).collect()}
    assert got == {"Agency": ("publisher", 1.0), "distribution_file_url": ("distribution.downloadURL", 1.0), "topic": ("keyword", 0.909), "title": ("", 0.0), "zzz": ("", 0.0)}


def test_roles(spark):
    df = spark.createDataFrame([(1, "2024-01-02", "40%", "a@b.example", "open"), (2, "2024-01-03", "7%", "c@d.example", "shut")], "case_id int, when string, percent_done string, mail string, status string")
    got = {(r.field_name, r.inferred_role): r.confidence for r in roles.infer_roles(df).collect()}
    assert got["case_id", "entity_id_field"] == 0.75 and got["when", "date_field"] == 0.8
    assert got["percent_done", "percentage_field"] == 0.86 and got["mail", "contact_email_field"] == 0.9 and got["status", "status_field"] == 0.75


def _zip(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name.replace("__", "/").replace("UP", ".."), data)
    return out.getvalue()


def test_archives_and_resource_profiles(spark, tmp_path):
    data = _zip(**{"data__t.csv": "id,date\n1,2024-01-01\n", "readme.txt": "x", "p.png": "x", "UP__evil.csv": "a\n1\n", "q.bin": "x"})
    entries, error = archives.zip_members(data)
    assert error == "" and {e["inner_file_name"]: e["skip_reason"] for e in entries} == {
        "data/t.csv": "", "readme.txt": "manifest_only", "p.png": "skipped_extension", "../evil.csv": "unsafe_path", "q.bin": "unsupported_extension",
    }
    assert archives.zip_members(b"no zip")[1] == "corrupted_zip"
    assert archives.zip_members(data, most_files=1)[0][-1]["skip_reason"] == "zip_file_limit_reached_1"
    assert archives.header_row([["Report", None], ["id", "name"], ["1", "2"]]) == 1
    (tmp_path / "a.zip").write_bytes(data)
    (tmp_path / "b.csv").write_text("incident_id,city,count\n1,X,3\n2,Y,4\n", encoding="utf-8")
    rows = [(0, "d", "CSV", str(tmp_path / "b.csv")), (1, "d", "ZIP", str(tmp_path / "a.zip")), (2, "d", "PDF", "x"), (3, "e", "CSV", str(tmp_path / "gone.csv"))]
    df = spark.createDataFrame(rows, "ord long, dataset_id string, format string, downloadURL string")

    def fail(url, timeout, most):
        raise OSError("no network")

    profiles, manifest = resources.profile_resources(df, allow_zip=True, get=fail)
    got = profiles.collect()
    assert len(profiles.columns) == 19 and [r.detected_columns for r in got] == ["incident_id | city | count", "id | date", ""]
    assert got[0].row_count_estimate == 2 and got[0].inferred_id_fields == "incident_id" and got[2].errors == "no network"
    assert manifest.count() == 5 and len(manifest.columns) == 10
    closed, _ = resources.profile_resources(df.where("format = 'ZIP'"))
    assert closed.first().errors == "skipped_zip_allow_zip_false"


def test_headers_over_several_rows():
    assert archives.flatten_headers([" id ", ("count", "2024"), ("total", None), ("x", "nan")]) == ["id", "count 2024", "total", "x"]


def test_payloads():
    assert classify_payload(b'{"@type":"dcat:Dataset"}', "") == (".json", "dcat_json")
    assert classify_payload(b"[1]", "application/json") == (".json", "json")
    assert classify_payload(b"{bad", "") == (".txt", "text") and classify_payload(b"<a/>", "") == (".xml", "xml")


def test_paged_search_and_commands(spark, tmp_path, capsys):
    pages = {"": {"results": [{"id": "a", "title": "Road crash data"}], "after": "c1"}, "c1": {"data": {"results": [{"dcat": {"identifier": "b", "title": "Road crash map"}}]}}}

    def get(url, timeout, most):
        return json.dumps(pages["c1" if "after=c1" in url else ""]).encode(), "application/json"

    raw, flat, terms, out = (tmp_path / n for n in ("raw.jsonl", "flat.csv", "terms.csv", "clusters.csv"))
    assert cli.main(["fetch", "--endpoint", "https://c.example/search", "--sleep", "0", "--out", str(raw)], get) == 0
    assert [json.loads(x)["id"] for x in raw.read_text().splitlines()] == ["a", "b"]
    assert cli.main(["flatten", "--input", str(raw), "--out", str(flat)]) == 0
    assert cli.main(["profile-terms", "--metadata", str(flat), "--out", str(terms)]) == 0
    assert cli.main(["cluster-terms", "--input", str(terms), "--min-count", "1", "--method", "fuzzy", "--out", str(out)]) == 0
    report = tmp_path / "report.md"
    assert cli.main(["report", "--metadata", str(flat), "--terms", str(terms), "--clusters", str(out), "--out", str(report)]) == 0
    assert "Metadata records analyzed: 2" in report.read_text()
    assert cli.main(["flatten", "--input", str(tmp_path / "none.jsonl")]) == 1
    assert cli.main(["profile-terms"]) == 2
    assert "does not exist" in capsys.readouterr().err
    assert list(catalog.search_pages("e", get=lambda *a: (b"[1]", ""))) == []
