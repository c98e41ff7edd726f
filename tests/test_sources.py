"""Sources and streams: pages that fail, replays, files that come in, exact ways beyond the limits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexistrata.functions.similarity import can_compare
from lexistrata.functions.text import block_keys
from lexistrata.operators import blocking, clusters
from lexistrata.sources import catalog
from lexistrata.streaming import records as streams

PAGES = {"": ("c1", ["a", "b"]), "c1": ("c2", ["c"]), "c2": ("c3", ["d", "e"]), "c3": ("", ["f"])}


def pages(fail=()):
    """A transport over ``PAGES``; the numbered requests in ``fail`` go wrong."""
    asked = []

    def get(url, timeout, most):
        asked.append(url)
        if len(asked) - 1 in fail:
            raise OSError("lost")
        after, ids = PAGES[url.partition("after=")[2]]
        return json.dumps({"results": [{"id": i} for i in ids], "after": after}).encode(), ""

    return get


def _ids(rows):
    return [json.loads(record)["id"] for _, record in rows]


def test_a_failing_page_loses_nothing():
    options = {"endpoint": "https://c.example/s", "perPage": "2", "sleep": "0"}
    reader = catalog._StreamReader(options, pages(fail={1, 2, 3}))
    at, got = reader.initialOffset(), []
    rows, at = reader.read(at)
    got += _ids(rows)
    with pytest.raises(RuntimeError, match="lost"):  # three attempts fail: the offset stays
        reader.read(at)
    start = at
    while not at["done"]:
        rows, at = reader.read(at)
        got += _ids(rows)
    assert got == list("abcdef") and at["n"] == 6
    assert _ids(reader.readBetweenOffsets(start, at)) == list("cdef")
    assert _ids(reader.readBetweenOffsets(at, at)) == []
    assert _ids(catalog._Reader(options, pages(fail={1, 3})).read(None)) == list("abcdef")  # asked for again
    with pytest.raises(RuntimeError, match="lost"):
        list(catalog._Reader(options, pages(fail={1, 2, 3})).read(None))
    told = []
    some = list(catalog.search_pages("https://c.example/s", per_page=2, sleep=0, get=pages(fail={1, 2, 3}), failed=told.append))
    assert len(some) == 1 and told == ["lost"]


def test_pages_as_batch_and_stream(spark, tmp_path):
    held = PAGES

    class Search(catalog.CatalogSource):
        @staticmethod
        def transport(url, timeout, most):
            after, ids = held[url.partition("after=")[2]]
            return json.dumps({"results": [{"id": i, "title": "T " + i} for i in ids], "after": after}).encode(), ""

        @classmethod
        def name(cls):
            return "search_test"

    spark.dataSource.register(Search)
    batch = spark.read.format("search_test").options(endpoint="https://c.example/s", perPage="2", sleep="0").load()
    assert sorted(json.loads(r.record)["id"] for r in batch.collect()) == list("abcdef")
    flat = streams.flattened(streams.read_search(spark, "https://c.example/s", source="search_test", perPage="2", sleep="0"), "ord")
    query = flat.select("ord", "id", "title").writeStream.format("memory").queryName("pages_seen").outputMode("append").start()
    for _ in range(6):
        query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("pages_seen").collect()) == [(i + 1, c, f"T {c}") for i, c in enumerate("abcdef")]


def test_lines_come_in_and_are_written_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id":"a","title":"Roads"}\n[1]\n{bad\n', encoding="utf-8")
    for name in ("a", "b"):
        rows = streams.flattened(streams.read_lines(spark, str(folder))).select("id", "title")
        streams.write_table(rows, str(out), str(state)).awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(str(out)).collect())
        assert got == [("a", "Roads"), ("b", "")][: 1 if name == "a" else 2]
        (folder / "b.jsonl").write_text('{"id":"b"}\n', encoding="utf-8")


def test_exact_ways_leave_out_nothing(spark):
    rng = random.Random(2)
    words = ["road", "bridge", "river", "school", "forest"]
    names = sorted({" ".join(["zebra", *rng.sample(words, rng.randint(1, 3)), f"x{rng.randint(0, 150)}"]) for _ in range(500)} | {"csv", "comma separated values"})
    terms = spark.createDataFrame([(n,) for n in names], "term string")
    assert blocking.left_out(terms, 20).count() > 0  # "zebra" is in almost all
    both = terms.select(F.col("term").alias("l")).crossJoin(terms.select(F.col("term").alias("r"))).where("l < r")
    plain = both.where(can_compare(F.col("l"), F.col("r")) & F.arrays_overlap(block_keys(F.col("l")), block_keys(F.col("r"))))
    expected = {tuple(r) for r in plain.collect()}
    assert {tuple(r) for r in blocking.candidate_pairs(terms, exact=True).collect()} == expected
    assert {tuple(r) for r in blocking.candidate_pairs(terms, most=20).collect()} < expected
    # A chain of more terms than a cluster may have stays whole, and so do n-gram edges above their limit.
    chain = spark.createDataFrame([(f"n{i:04}", f"n{i + 1:04}", 1.0, "exact") for i in range(520)], "l string, r string, score double, reason string")
    nodes = chain.select(F.col("l").alias("term")).union(chain.select("r")).distinct()
    assert clusters.assign_clusters(nodes, chain).select("cluster_id").distinct().count() == 521
    assert clusters.assign_clusters(nodes, chain, None).select("cluster_id").distinct().count() == 1
    some = terms.limit(40)
    assert clusters.build_edges(some, method="tfidf", most=10).where("reason = 'tfidf'").count() == 0
    assert clusters.build_edges(some, method="tfidf", most=10, exact=True).where("reason = 'tfidf'").count() > 0
