"""Nested records, packed fields and times: defined cases, small fixtures, an independent reading of the rules."""

import json
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from lexistrata.operators import nested, packed, timestamps


def _found(table):
    return sorted((r._ord, r.v) for r in table.select("_ord", F.col("_item").cast("string").alias("v")).collect())


def test_only_one_whole_json_object_is_a_record(spark):
    texts = ['{"a":1}', ' {"a":{"b":2}} ', "[1]", "5", "", None, '{"a":1} {"b":2}', '{"a":1}x', '{"a":1,}', '{"a":NaN}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    ok = [r.ok for r in rows.select(nested.parse_object(F.col("t")).isNotNull().alias("ok")).collect()]
    assert ok == [True, True] + [False] * 8


def test_lists_objects_and_odd_items_keep_their_places(spark):
    line = {"r": [{"u": "x"}, None, 3, {"u": "y"}], "o": {"u": "z"}, "e": [], "n": None}
    rows = spark.createDataFrame([(1, json.dumps(line))], "k int, t string").select("k", nested.parse_object(F.col("t")).alias("d"))
    items = nested.child_table(rows, ["k"], "d", "r[]")
    assert [r._ord for r in items.orderBy("_ord").collect()] == [0, 1, 2, 3]
    urls = items.where(nested.is_object(F.col("_item"))).select("_ord", F.try_variant_get("_item", "$.u", "string").alias("u"))
    assert sorted(map(tuple, urls.collect())) == [(0, "x"), (3, "y")]
    one = nested.child_table(rows, ["k"], "d", "o[]").collect()
    assert [(r._ord, r._single) for r in one] == [(0, True)]
    assert nested.child_table(rows, ["k"], "d", "e[]").count() == nested.child_table(rows, ["k"], "d", "n[]").count() == 0


def test_merged_schema_and_shredding_keep_parents(spark):
    lines = ['{"a":[{"b":[1,2]},{"b":[3]}]}', '{"a":{"b":4},"c":"s"}', "bad", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, t string")
    schema = nested.merged_schema(rows, "t")
    kinds = {(r.path, r.kind): r.n for r in schema.collect()}
    assert kinds["a", "array"] == 1 and kinds["a", "object"] == 1 and kinds["a[].b[]", "scalar"] == 3
    docs = rows.select("k", nested.parse_object(F.col("t")).alias("d"))
    tables = nested.shred(docs, ["k"], "d", schema)
    inner = tables["a[].b[]"].collect()
    assert sorted((r.k, r._parent[0], r._ord) for r in inner) == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)]


def test_struct_columns_are_shredded_by_their_schema(spark):
    rows = spark.createDataFrame([(1, [("a", [1, 2]), None]), (2, None), (3, [])], "k int, s array<struct<n:string,v:array<int>>>")
    tables = nested.shred_struct(rows, ["k"], "s")
    assert [(r.k, r._ord) for r in tables["s[]"].orderBy("_ord").collect()] == [(1, 0), (1, 1)]
    assert sorted((r._parent, r._ord, r._item) for r in tables["s[].v[]"].collect()) == [([0], 0, 1), ([0], 1, 2)]


CASES = {
    "a; b;c": ["a", "b", "c"],
    "a | b|": ["a", "b"],
    "x;;y": ["x", "y"],
    "one/two": ["one/two"],
    "one / two": ["one", "two"],
    "1,000-year flood": ["1,000-year flood"],
    "1,000-year flood, drought": ["1,000-year flood", "drought"],
    '"a, b"': ["a, b"],
    '"a, b";c': ["a, b", "c"],
    '"a ""b""", c': ['a "b"', "c"],
    '["a", "b c"]': ["a", "b c"],
    "['a', 'b']": ["a", "b"],
    "001:02/003:04": ["001:02", "003:04"],
    "001:02 003:04": ["001:02", "003:04"],
    "001:02,003:04": ["001:02", "003:04"],
    "a；b": ["a", "b"],
    "single \n": ["single"],
    "a; b,c": ["a", "b", "c"],
    "research & development": ["research & development"],
    "": [],
    "   ": [],
}


def test_packed_values(spark):
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*CASES, None])], "i int, item string, value string")
    got = {r.i: r._values for r in packed.unpack(rows, "item").collect()}
    for i, (text, values) in enumerate(CASES.items()):
        assert got[i] == values, text
    assert got[len(CASES)] == []
    long = spark.createDataFrame([(";".join(["v"] * 50_000),)], "item string")
    assert len(packed.unpack(long, "item").first()._values) == 50_000
    assert packed.unpack(rows.limit(0), "item").count() == 0


def _instant(year, month, day, hour=0, minute=0, second=0, zone="UTC", micros=0):
    at = datetime(year, month, day, hour, minute, second, tzinfo=ZoneInfo(zone)).astimezone(timezone.utc)
    return int(at.timestamp()) * 1_000_000 + micros


NY, BERLIN = ("America/New_York", "MDY"), ("Europe/Berlin", "DMY")
TIMES = [
    ("2017-06-19T03:14:39", NY, _instant(2017, 6, 19, 3, 14, 39, "America/New_York")),
    ("2017-06-19T03:14:39Z", NY, _instant(2017, 6, 19, 3, 14, 39)),
    ("2016-11-20T05:18:24,271999999Z", NY, _instant(2016, 11, 20, 5, 18, 24, micros=271999)),
    ("2022-04", NY, _instant(2022, 4, 1, zone="America/New_York")),
    ("03/04/2020", NY, _instant(2020, 3, 4, zone="America/New_York")),
    ("03/04/2020", BERLIN, _instant(2020, 4, 3, zone="Europe/Berlin")),
    ("13/04/2020", NY, None),
    ("08/21/20 12:05 am", NY, _instant(2020, 8, 21, 0, 5, zone="America/New_York")),
    ("1717059121", NY, 1717059121_000000),
    ("1422038168472", NY, 1422038168472_000),
    ("20221202T182037+0100", NY, _instant(2022, 12, 2, 17, 20, 37)),
    ("20. Oktober 2020, 15:14 Uhr", BERLIN, _instant(2020, 10, 20, 15, 14, zone="Europe/Berlin")),
    ("11 de octubre de 2020, 17:45", BERLIN, _instant(2020, 10, 11, 17, 45, zone="Europe/Berlin")),
    ("2 février 2017 à 00:23", BERLIN, _instant(2017, 2, 2, 0, 23, zone="Europe/Berlin")),
    ("Oct 28 2017 02:29PM", NY, _instant(2017, 10, 28, 14, 29, zone="America/New_York")),
    ("Tue, 07 Feb 2023 07:53:59 GMT", NY, _instant(2023, 2, 7, 7, 53, 59)),
    ("2016-10-18 12:29:02 PM CEST", NY, _instant(2016, 10, 18, 10, 29, 2)),
    ("2020-09-27 10:25:48 America/Chicago", BERLIN, _instant(2020, 9, 27, 10, 25, 48, "America/Chicago")),
    ("2019-10-27 02:30", BERLIN, _instant(2019, 10, 27, 0, 30)),  # occurs twice: the earlier
    ("2019-03-31 02:30", BERLIN, _instant(2019, 3, 31, 1, 30)),  # skipped: on by the gap
    ("2021-02-30", NY, None),
    ("31/11/2020 10:00", NY, None),
    ("ongoing", NY, None),
    ("R/P1M", NY, None),
    ("", NY, None),
    (None, NY, None),
]


def test_times(spark):
    rows = spark.createDataFrame([(i, t, p[0], *p) for i, (t, p, _) in enumerate(TIMES)], "i int, t string, src string, tz string, o string")
    got = {r.i: r.utc_micros for r in timestamps.normalise_times(rows, "t", "src", "tz", "o").collect()}
    for i, (text, place, expected) in enumerate(TIMES):
        assert got[i] == expected, (text, place)


def test_order_without_declaration_is_learned_or_left_open(spark):
    rows = [("a", "25/12/2020")] * 30 + [("a", "05/06/2020"), ("b", "05/06/2020")]
    table = spark.createDataFrame(rows, "src string, t string").withColumn("tz", F.lit("UTC")).withColumn("o", F.lit(None).cast("string"))
    got = timestamps.normalise_times(table, "t", "src", "tz", "o").where("t = '05/06/2020'").collect()
    by = {r.src: r for r in got}
    assert by["a"].utc_micros == _instant(2020, 6, 5) and not by["a"].ambiguous
    assert by["b"].utc_micros is None and by["b"].ambiguous
