"""Queries over terms whose blocks are above the feature's limits leave out nothing, and the term table is made without large stages."""

import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from lexistrata import queries
from lexistrata.engine import shared_folder
from lexistrata.operators import terms

MANY = 160
COMMON = "constellation grandfather meadowland sensor thunderstorm"


@pytest.fixture
def many(spark, monkeypatch):
    """Terms that share all words but one too short for a key: each of their blocks has more than 150 terms."""
    names = [f"{COMMON} {a}{b}" for a in "abcdefghijklmnop" for b in "0123456789"]
    rows = [(n, n, "tags", 2, "", "Sky") for n in [*names, "bridge"]]
    table = spark.createDataFrame(rows, "term string, normalized_term string, source_field string, count long, example_record_ids string, example_titles string")
    monkeypatch.setattr(queries, "_cluster_input", lambda *_: table)
    return lambda name: queries.queries()[name](spark, "").collect()


def test_candidate_pairs_of_large_blocks(many):
    assert len(many("candidate_pairs")) == MANY * (MANY - 1) // 2


def test_token_set_edges_of_large_blocks(many):
    assert len(many("token_set_edges")) == MANY * (MANY - 1) // 2


def test_tfidf_edges_of_large_blocks(many):
    assert len(many("tfidf_edges")) > MANY


def test_cluster_rows_of_large_blocks(many):
    rows = many("cluster_rows")
    assert len(rows) == MANY + 1 and len({r.cluster_id for r in rows}) == 2 and {r.examples for r in rows} == {"Sky"}


def test_cluster_metrics_of_large_blocks(many):
    assert [(r.total_terms, r.total_clusters, r.largest_cluster_size) for r in many("cluster_metrics")] == [(MANY + 1, 2, MANY)]


def test_drop_singletons_of_large_blocks(many):
    assert len(many("drop_singletons")) == MANY


def test_top_clusters_of_large_blocks(many):
    assert [r["count"] for r in many("top_clusters")] == [2 * MANY]


def test_validation_sample_of_large_blocks(many):
    assert len(many("validation_sample")) == 2


def test_domain_clusters_of_large_blocks(many):
    assert [r["count"] for r in many("domain_clusters")] == [2 * MANY]


def test_first_values_survive_any_cut_into_batches(monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randint(1, 4), o, rng.randint(0, 3), rng.randint(0, 12), rng.randint(0, 6)) for o in rng.sample(range(10_000), 600)]

    def firsts(of, at):
        best = defaultdict(dict)
        for k, o, p, *values in of:
            if values[at]:
                best[k][values[at]] = min(best[k].get(values[at], (o, p)), (o, p))
        return {k: sorted(v.items(), key=lambda x: x[1])[: terms.EXAMPLES] for k, v in best.items()}

    monkeypatch.setattr(terms, "BATCH_ROWS", 50)
    parts = [pa.RecordBatch.from_arrays([pa.array(np.array(c)) for c in zip(*rows[i : i + 30], strict=True)], list("kopit")) for i in range(0, 600, 30)]
    kept = [tuple(r.values()) for b in terms._first_of_batch(iter(parts)) for r in b.to_pylist()]
    assert len(kept) < len(rows) and set(kept) <= set(rows)
    assert all(firsts(kept, at) == firsts(rows, at) for at in (0, 1))


def test_profile_stages_are_small(spark):
    """Rows of terms are not written with their records' texts."""
    text = " ".join(f"{a}{b}cd" for a in "aeiou" for b in "bdfgklmnpr")
    rows = [(i, f"id-{i}", f"title {i % 7} " + text) for i in range(300)]
    table = spark.createDataFrame(rows, "ord long, id string, title string")
    folder = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    assert terms.profile_terms(table).count() > 100
    assert size() - before < 4 * 300 * len(text)


def test_terms_of_blocks_are_counted_without_examples(spark, monkeypatch):
    """Keys and pairs of terms need no examples, so that none are sought."""
    asked = []
    found = terms.profile_terms
    empty = spark.createDataFrame([], "ord long, id string, title string, " + ", ".join(f"{f} string" for f in queries.TERM_FIELDS if f != "title"))
    monkeypatch.setattr(queries, "_after", lambda *_: 0)
    monkeypatch.setattr(queries, "_flat", lambda *_: empty)
    monkeypatch.setattr(terms, "profile_terms", lambda *a, **k: asked.append(k["examples"]) or found(*a, **k))
    assert queries._cluster_terms(spark, "").count() == 0 and asked == [()]
