"""Operators of the llm subpackage: defined cases, brute force, exact round trips."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexistrata.llm import leakage, name_variants, set_join, tokenize, truncation, value_mapping
from lexistrata.llm.term_frequency import term_frequency


def test_term_frequency_counts_records_and_occurrences(spark):
    rows = [(1, "a", ["X ", "x", None, ""]), (2, "a", ["x"]), (3, "b", ["y"]), (4, None, ["y"]), (5, None, None), (6, "c", [])]
    df = spark.createDataFrame(rows, "row_id int, id string, term array<string>")
    got = {r.term: (r.occurrences, r.records, r.all_records, r.mark) for r in term_frequency(df, {"f": F.col("term")}, F.col("id"), F.col("row_id")).collect()}
    assert got == {"x": (3, 1, 5, "rare"), "y": (2, 2, 5, "rare")}
    assert term_frequency(df.limit(0), {"f": F.col("term")}, F.col("id"), F.col("row_id")).count() == 0
    common = spark.createDataFrame([(i, str(i), ["t"]) for i in range(5)], df.schema)
    assert term_frequency(common, {"f": F.col("term")}, F.col("id"), F.col("row_id")).first().mark == "common"


NAMES = [
    ["Kozmul County Department of Transportation", "Kozmul Cnty. Dept. of Transp.", "DOT - Kozmul County", "Transportation, Department of (Kozmul County)", "Kozmul County Departmnet of Transportation", "Kozmul Department of Transportation"],
    ["Kozmul County Department of Health", "KOZMUL COUNTY DEPARTMENT OF HEALTH", "Health Department, Kozmul County"],
    ["Barvik City Department of Health", "City of Barvik Department of Health"],
    ["Robert Vestrop", "Bob Vestrop", "Vestrop, Robert", "Dr. Robert Vestrop", "Vestrop Robert"],
    ["Susan Vestrop"],
]


def test_names_of_one_body_or_person_come_together(spark):
    typed = [(n,) for group in NAMES for n in group] + [(None,), ("",), ("  ",), (NAMES[0][0],)]
    members = name_variants.resolve_names(spark.createDataFrame(typed, "name string"), "name")
    got = sorted(map(tuple, name_variants.variant_pairs(members, "name").collect()))
    assert got == sorted(tuple(sorted(p)) for group in NAMES for p in itertools.combinations(group, 2))


def test_values_are_mapped_or_reported(spark):
    listed = spark.createDataFrame([(1, "CSV", "text/csv", "csv"), (2, "JSON", "application/json", "json"), (3, "XLS", "application/vnd.ms-excel", "xls")], "format_id int, label string, media_type string, extension string")
    dictionary = value_mapping.reference_forms(listed, "format_id", ["label", "media_type", "extension"], value_mapping.alias_table(listed, "format_id", "label"))
    cases = {" CSV": 1, "*.csv": 1, "text / csv; charset=utf-8": 1, "Cmoma Separated Values": 1, "plain json [JSON]": 2, "application/vnd.ms-excell": 3, "paper copy": 0, "???": 0, "x" * 5000: 0}
    typed = spark.createDataFrame([(v,) for v in cases] * 2 + [(None,), ("",), (" ",)], "value string")
    got = {r.value: r.entry for r in value_mapping.map_values(typed, "value", dictionary).collect()}
    assert got == cases
    assert value_mapping.map_values(typed.limit(0), "value", dictionary).count() == 0


def test_other_names_are_learned_from_what_stands_beside_them(spark):
    listed = spark.createDataFrame([(1, "CSV", "text/csv"), (2, "JSON", "application/json")], "format_id int, label string, media_type string")
    dictionary = value_mapping.reference_forms(listed, "format_id", ["label", "media_type"], None)
    typed = [("Comma Separated", "text/csv")] * 5 + [("unknown", m) for m in ("text/csv", "application/json")] * 5 + [("rare name", "text/csv"), (None, "text/csv"), ("x", None)]
    beside = spark.createDataFrame(typed, "value string, other string")
    learned = value_mapping.learned_forms(beside, dictionary)
    assert [tuple(r) for r in learned.select("entry", "form").collect()] == [(1, "comma separated")]
    values = spark.createDataFrame([("comma separated",), ("comma seperated",), ("unknown",), ("json",)], "value string")
    got = {r.value: r.entry for r in value_mapping.map_values(values, "value", dictionary.unionByName(learned)).collect()}
    assert got == {"comma separated": 1, "comma seperated": 1, "unknown": 0, "json": 2}
    assert value_mapping.learned_forms(beside.limit(0), dictionary).count() == 0


def test_distances_of_a_batch_equal_those_of_each_pair():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(300)]
    pairs = list(zip(texts, [t[: rng.randint(0, len(t))] + rng.choice(["", "a", "bb"]) + t[rng.randint(0, len(t)) :] for t in texts], strict=True))

    def plain(a, b):
        rows = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    rows[i, j] = (i + j, float(i + j))
                    continue
                (u, x), (v, y), (w, z) = rows[i - 1, j], rows[i, j - 1], rows[i - 1, j - 1]
                same = a[i - 1] == b[j - 1]
                options = [
                    (u + 1, x + (0.7 if a[max(i - 2, 0)] == a[i - 1] and i > 1 else 1)),
                    (v + 1, y + (0.7 if b[max(j - 2, 0)] == b[j - 1] and j > 1 else 1)),
                    (w + (not same), z + (0 if same else 1 if i > 1 and j > 1 else 1.2)),
                ]
                if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                    options.append((rows[i - 2, j - 2][0] + 1, rows[i - 2, j - 2][1] + 0.8))
                rows[i, j] = min(options)
        return rows[len(a), len(b)]

    got = value_mapping.weighted_distances([a for a, _ in pairs], [b for _, b in pairs], [2] * len(pairs))
    for (a, b), found in zip(pairs, got, strict=True):
        edits, weight = plain(a, b)
        assert (math.isnan(found) and edits > 2) or (edits <= 2 and abs(found - weight) < 1e-5), (a, b)


def test_abbreviations_are_learned_from_names_that_else_agree(spark):
    names = [f"{place} County {dept} of {what}" for place in ("Arvik", "Bolmar", "Cintol") for what in ("Health", "Roads") for dept in ("Department", "Dept")] + ["Arvik Cnty Dept of Health"]
    members = name_variants.resolve_names(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    entity = {r.name: r.entity for r in members.collect()}
    assert entity["Arvik Cnty Dept of Health"] == entity["Arvik County Dept of Health"] == entity["Arvik County Department of Health"]
    assert len(set(entity.values())) == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_sets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    sets = []
    for _ in range(150):
        base = rng.sample(words, rng.randint(1, 12)) if not sets or rng.random() < 0.5 else list(rng.choice(sets))
        for _ in range(rng.randint(0, 2)):
            base = base[1:] if rng.random() < 0.5 and len(base) > 1 else [*base, rng.choice(words)]
        sets.append(base)
    rows = [(i, f"g{i % 60}" if i % 7 else None, s + [None, ""]) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "k long, g string, v array<string>")
    got = sorted(map(tuple, set_join.similar_sets(df, "k", "v", group="g").collect()))
    expected = []
    for (i, a, s), (j, b, t) in itertools.combinations([(i, g, set(s)) for (i, g, _), s in zip(rows, sets, strict=True)], 2):
        if (a is None or b is None or a != b) and min(len(s), len(t)) >= 3 and 5 * len(s & t) >= 3 * len(s | t):
            expected.append((i, j))
    assert got == expected


def test_token_ids_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    known = tokenizers.Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    known.encode_special_tokens = True
    texts = ["Hello world, it's 2024!", "  two  spaces \n\n", "naïve Straße 日本語 🙂", "<|endoftext|>", "a" * 3000, "", None, " ", "don't can't 'tis", "x y​z"]
    df = spark.createDataFrame(list(enumerate(texts * 2)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenize.encode_corpus(df, "doc_id", "text", lexicon=5).collect()}
    for i, text in enumerate(texts * 2):
        assert got[i] == known.encode(text or "", add_special_tokens=False).ids
    assert tokenize.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_transducer_holds_its_words_and_no_others():
    words = [b"car", b"cars", b"bar", b"bars", b"b", b"star", b""]
    fst = tokenize.compile_transducer(words, [[i] * (i + 1) for i in range(len(words))])
    found = tokenize.look_up(fst, [*words[:-1], b"ca", b"carsx", b"zzz"])
    ordered = sorted(words)
    assert [ordered[n] for n in found[:6]] == words[:6] and list(found[6:]) == [-1, -1, -1]
    assert len(fst["final"]) < sum(map(len, words))


def test_leaks_are_found_and_quotations_are_not(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    passages = [" ".join(rng.sample(words, 60)) for _ in range(5)]
    items = spark.createDataFrame([*enumerate(passages), (9, None), (10, "")], "item_id int, passage string")
    half = " ".join(passages[1].split()[10:45])
    docs = ["noise " * 50 + passages[0].upper().replace(" ", "  "), f"<p>x {half}</p>", "quote " + " ".join(passages[2].split()[:10]), None, "", passages[0] + " " + passages[3], passages[0]]
    got = leakage.leaked_items(spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string"), "doc_id", "text", items, "item_id", "passage")
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 0), (1, 1), (5, 0), (5, 3), (6, 0)]


def test_edited_and_near_copied_passages_leak_by_index_and_by_join(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    base = rng.sample(words, 80)
    copies = [[*base[:i], "other", *base[i + 1 :]] for i in range(10)]  # ten near-copies hold almost all shingles in common
    passages = [" ".join(c) for c in copies] + [" ".join(rng.sample(words, 70)), "five words and no more", None, ""]
    edited = passages[10].split()
    for k in range(3, len(edited), 7):  # no eight words in a row are left as they were
        edited[k] = "changed"
    docs = ["x " * 30 + passages[3], "y " + " ".join(edited), "so five words and no more, said they", "nothing of it " * 20, None, ""]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    expected = {(0, i) for i in range(10)} | {(1, 10), (2, 11)}
    for most in (leakage.INDEX_WORDS, 10):
        found = leakage.leaked_items(corpus, "doc_id", "text", items, "item_id", "passage", index_words=most).collect()
        assert {(r.doc_id, r.item_id) for r in found} == expected and all(r.share >= 0.4 for r in found)
    assert leakage.leaked_items(corpus, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0
    assert leakage.leaked_items(corpus.limit(0), "doc_id", "text", items, "item_id", "passage", index_words=10).count() == 0


def test_cut_texts(spark):
    rng = random.Random(5)
    names = ["river", "school", "bridge", "harbor", "forest", "museum"]

    def sentence():
        return f"The {rng.choice(names)} table lists the {rng.choice(names)} counts of {rng.choice(names)} sites measured in 20{rng.randint(10, 24)}."

    whole = [" ".join(sentence() for _ in range(rng.randint(3, 9))) for _ in range(300)]
    listed = [w + "\n- river counts\n- school counts" for w in whole[:60]]
    cut = [w[: len(w) - rng.randint(12, 40)].rstrip(". ") for w in whole[100:140]]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate([*whole, *listed, *cut, None, "", "  "])]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    got = {r.doc_id for r in truncation.score_texts(df, "doc_id", "text", "lang", "source").where("cut").collect()}
    true = set(range(360, 400))
    assert len(got & true) >= 36 and len(got - true) <= 4
    assert truncation.score_texts(df.limit(0), "doc_id", "text", "lang", "source").count() == 0


def test_scores_of_texts_count_all_distinct_texts(spark):
    """Equal to counting the contexts of every text as strings; more texts than any sample had."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    texts = [f"{rng.choice(words)} {rng.choice(words)} {i % 7}\n- {rng.choice(words)}" for i in range(9500)]
    texts += ["see https://x.example/abc/def", "see https://x.example/abc/def", "cut &am", texts[0]]
    seen, tails, apart = Counter(), defaultdict(set), Counter()
    ends, on = set(), 0
    for text in set(texts):
        unit, broken = truncation.units(text)
        whole, listed = "\n" + unit, [line.startswith("- ") for line in unit.split("\n") for _ in range(len(line) + 1)]
        for i, char in enumerate(whole):
            if char == "\n":
                continue
            final = i + 1 == len(whole)
            ended = not broken if final else whole[i + 1] == "\n"
            tail = whole[max(0, i + 1 - truncation.TAIL) : i + 1]
            ends |= {tail} if ended else set()
            on += not ended
            for k in truncation.ORDERS:
                context = (k, listed[i], whole[max(0, i + 1 - k) : i + 1])
                if ended:
                    tails[context].add(tail)
                else:
                    seen[context] += 1
                    apart[context] += final or not whole[i + 1].isalnum()
    base = len(ends) / (len(ends) + on)

    def odds(text):
        unit, broken = truncation.units(text)
        if broken:
            return 30.0
        link = "://" in unit.split()[-1]
        whole = "\n" + unit
        asked = "\n" + re.sub(r"\W+", " ", unit.split()[-1]) if link else whole
        start = p = 0.2 if link else base
        for k in truncation.ORDERS:
            context = (k, not link and unit.rpartition("\n")[2].startswith("- "), asked[-k:])
            e, n = len(tails[context]), seen[context]
            if (e or n > 2) and e + n > 1:
                counted = e + apart[context] if link else e
                off = min(counted, 1) if asked[-k:] == whole[-k:] else 0
                p = (counted - off + 3 * p) / (e + n - off + 3)
        return max(-30.0, min(30.0, math.log((1 - p) / p) - math.log((1 - start) / start)))

    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id int, text string, lang string, source string")
    got = {r.doc_id: r.log_odds for r in truncation.score_texts(df, "doc_id", "text", "lang", "source").collect()}
    assert len(got) == len(texts) and all(abs(got[i] - odds(t)) < 1e-6 for i, t in enumerate(texts))
