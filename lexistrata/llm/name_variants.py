"""Spelling variants of the bodies and persons that people type.

Every distinct name becomes a profile: a body's place, level, words and short form, or a person's given name, initials and
surname. Misspelt words are corrected against the words of the other names by symmetric deletes. Profiles with equal keys
merge at once. Then merge and rematch: incomplete profiles (a short form, no level, some of the words, initials, a
nickname) look for the one profile that they can mean; merging unions spellings, words, initials and short forms, and the
richer profiles are blocked again, until a round merges nothing. A profile that could mean two stays apart.

All steps are joins on keys; no block is gathered or compared pair by pair.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint
from lexistrata.llm.value_mapping import PREFIX, deletes, weighted_distance

#: Words that tell the level of a body.
LEVELS = {"county", "city", "province", "region", "state", "town", "village", "municipality", "township", "borough"}
#: Abbreviated words of the names of public bodies; only for those who ask for them.
SHORT_WORDS = dict(
    pair.split("=")
    for pair in (
        "dept=department dpt=department dep=department ofc=office off=office bur=bureau bd=board comm=commission "
        "commn=commission cmsn=commission auth=authority agcy=agency agy=agency admin=administration adm=administration "
        "svc=service svcs=services serv=service dist=district div=division cncl=council mgmt=management mgt=management "
        "mgmnt=management prov=province cnty=county co=county reg=region rgn=region cty=county mun=municipality "
        "pub=public env=environmental environ=environmental envir=environmental stat=statistics stats=statistics "
        "transp=transportation trans=transportation transportn=transportation agric=agriculture agri=agriculture ag=agriculture rec=recreation "
        "ed=education educ=education lib=library libr=library libraries=library courts=court info=information "
        "hlth=health emerg=emergency vet=veterans vets=veterans geol=geological tech=technology dev=development "
        "natl=national intl=international univ=university inst=institute assn=association assoc=association "
        "sys=system syst=system prot=protection schls=schools sch=schools wks=works hsg=housing ind=industry"
    ).split()
)
#: Everyday words for the words in a body's name; only for those who ask for them.
EVERYDAY = {"visitor": "tourism", "visitors": "tourism", "cops": "police", "roads": "transportation"}
#: Words that say what kind of body it is.
HEADS = set(
    "department office bureau board commission authority agency service services survey system council division district "
    "administration ministry registry committee court library institute association centre center corps unit".split()
)
SMALL = {"of", "the", "and", "for", "a", "an", "de", "la"}
TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "professor", "sir", "jr", "sr", "phd", "md", "hon", "rev", "esq"}
#: Nicknames of given names.
NICKNAMES = {
    "robert": "bob bobby rob robbie bert", "william": "bill billy will willy liam", "michael": "mike mick mickey",
    "katherine": "kate katie kathy kat kay katharine catherine cathy", "elizabeth": "liz beth betty lizzie eliza betsy libby",
    "deborah": "deb debbie debby debra", "susan": "sue susie suzy", "anthony": "tony", "margaret": "peggy maggie meg marge greta",
    "theodore": "ted teddy theo", "edward": "ed eddie ned", "charlotte": "lottie charlie lotte", "charles": "charlie chuck chas",
    "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey", "thomas": "tom tommy", "richard": "rick dick rich",
    "patricia": "pat patty trish", "jennifer": "jen jenny", "barbara": "barb babs", "steven": "steve", "stephen": "steve",
    "daniel": "dan danny", "matthew": "matt", "christopher": "chris kit", "christine": "chris chrissie tina",
    "andrew": "andy drew", "joshua": "josh", "kenneth": "ken kenny", "timothy": "tim", "jeffrey": "jeff", "gregory": "greg",
    "benjamin": "ben", "samuel": "sam", "samantha": "sam", "alexander": "alex sandy al", "alexandra": "alex sandra",
    "nicholas": "nick", "jonathan": "jon", "lawrence": "larry", "gerald": "jerry", "donald": "don", "ronald": "ron",
    "raymond": "ray", "frederick": "fred freddy", "walter": "walt", "henry": "harry hank", "peter": "pete", "david": "dave",
    "victoria": "vicky tori", "rebecca": "becky", "virginia": "ginny", "dorothy": "dot dottie", "judith": "judy",
    "pamela": "pam", "cynthia": "cindy", "kimberly": "kim", "jacqueline": "jackie", "abigail": "abby", "eleanor": "ellie nell",
    "helen": "nell", "frances": "fran", "francis": "frank", "philip": "phil", "douglas": "doug", "leonard": "len lenny",
    "eugene": "gene", "albert": "al bert", "arthur": "art", "harold": "harry hal", "vincent": "vince", "zachary": "zach",
}
FORMAL = {nick: [f for f, names in NICKNAMES.items() if nick in names.split()] for names in NICKNAMES.values() for nick in names.split()}

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


def tokens_of(name: str) -> list[str]:
    """Words of a name in lower case, without accents; ``&`` and ``+`` are ``and``."""
    plain = unicodedata.normalize("NFKD", name)
    plain = "".join(c for c in plain if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    return _TOKEN.findall(re.sub(r"[&+]", " and ", plain).lower())


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(_tokens=[tokens_of(name) for name in batch["_name"]])


def _most_edits(length: Column) -> Column:
    return F.when(length < 4, 0).when(length < 5, 1).otherwise(2)


def _edits_between(a: str, b: str, much_rarer: bool) -> int:
    """Two edits for long words and for short ones beside a word that far more names hold."""
    return 2 if max(len(a), len(b)) >= 8 or much_rarer else 1


def learned_short_words(words: DataFrame, *, support: int = 2, share: float = 0.6) -> DataFrame:
    """``token, _long``: words that are short for a longer one, told from names that agree in all their other words.

    A word stands for one with the same first letter that has all its letters in order and that at least as many names
    hold, if at least ``support`` contexts (all other words of a name, in any order) have both, and ``share`` of those
    in which it may stand for anything. ``words`` has ``_name, token``.
    """
    telling = words.where(~F.col("token").isin(sorted(SMALL)))
    lines = telling.groupBy("_name").agg(F.array_sort(F.collect_list("token")).alias("_t")).where(F.size("_t") >= 3)
    slots = lines.select(
        F.explode(
            F.transform("_t", lambda t, i: F.struct(t.alias("token"), F.xxhash64(F.array_join(F.filter("_t", lambda _, j: j != i), " "), F.substring(t, 1, 1)).alias("_c")))
        ).alias("x")
    ).select("x.*").distinct()
    held = checkpoint(telling.groupBy("token").agg(F.count_distinct("_name").alias("_n")))
    slots = checkpoint(slots.join(held, "token"))
    longer = slots.select("_c", F.col("token").alias("_long"), F.col("_n").alias("_m"))
    # Two initialisms are no short and long word, however alike.
    pairs = slots.join(longer, "_c").where((F.length("_long") > 4) & (F.length("token") > 1) & (F.length("token") < F.length("_long")) & (F.col("_m") >= F.col("_n")))
    counted = pairs.where(F.rlike(F.col("_long"), _in_order(F.col("token")))).groupBy("token", "_long").agg(F.count("*").alias("k"), F.max("_m").alias("_m"))
    best = counted.groupBy("token").agg(F.sum("k").alias("all"), F.max(F.struct("k", "_m", "_long")).alias("b"))
    return best.where((F.col("b.k") >= support) & (F.col("b.k") >= share * F.col("all"))).select("token", F.col("b._long").alias("_long"))


def _spelled_out(words: DataFrame, short: DataFrame) -> DataFrame:
    """The words with the short ones replaced; one that stands for another short one goes on to what that one means."""
    short = checkpoint(short)
    then = short.select(F.col("token").alias("_long"), F.col("_long").alias("_then"))
    short = short.join(then, "_long", "left").select("token", F.coalesce("_then", "_long").alias("_long"))
    return checkpoint(words.join(short, "token", "left").select("_name", "_pos", F.coalesce("_long", "token").alias("token")))


def corrections(words: DataFrame, *, ratio: int = 4) -> DataFrame:
    """``token, _right``: words that are a few edits away from one that at least ``ratio`` times as many names hold.

    ``words`` has ``_name, token``. Of several, the nearest and then the most held one is right.
    """
    held = words.groupBy("token").agg(F.count_distinct("_name").alias("n"))
    known = sorted(LEVELS | SMALL | TITLES | set(NICKNAMES) | set(FORMAL))
    fixed = words.sparkSession.createDataFrame([(w,) for w in known], "token string")
    # Known words are right however rare they are.
    held = checkpoint(
        held.join(F.broadcast(fixed.withColumn("_fixed", F.lit(True))), "token", "full").select(
            "token", F.coalesce("n", F.lit(0)).alias("n"), F.col("_fixed").isNotNull().alias("_fixed")
        )
    )
    length = F.length("token")
    index = held.where(length >= 4).select(F.col("token").alias("_right"), F.col("n").alias("_m"), F.col("_fixed").alias("_sure"), F.explode(deletes(F.col("token"))).alias("_left"))
    # A word that may be short for one of the known words of bodies is no misspelling of another one.
    shortened = F.exists(
        F.array(*map(F.lit, sorted(LEVELS | HEADS))), lambda w: (length <= 0.75 * F.length(w)) & F.rlike(w, _in_order(F.col("token")))
    )
    asked = held.where((length >= 4) & ~F.col("_fixed") & ~F.col("token").rlike(r"\d") & ~shortened).select("token", "n", F.explode(deletes(F.col("token"), _most_edits(length))).alias("_left"))
    pairs = (
        asked.join(index, "_left")
        .where((F.col("token") != F.col("_right")) & ((F.col("_m") >= ratio * F.col("n")) | (F.col("_sure") & (F.col("_m") >= F.col("n")))))
        .where(F.abs(F.length("token") - F.length("_right")) <= 2)
        .select("token", "_right", "_m", "n")
        .distinct()
    )

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rarer = batch["_m"] >= 30 * batch["n"]
            found = [
                weighted_distance(a, b, _edits_between(a, b, r))
                for a, b, r in zip(batch["token"], batch["_right"], rarer, strict=True)
            ]
            yield batch.assign(_d=pd.Series(found, index=batch.index, dtype="float64")).dropna(subset=["_d"])

    measured = pairs.mapInPandas(near, "token string, _right string, _m long, n long, _d double")
    best = F.min(F.struct("_d", (-F.col("_m")).alias("m"), "_right")).alias("b")
    once = checkpoint(measured.groupBy("token").agg(best).select("token", "b._right"))
    # What a word is corrected to may be a more usual misspelling itself. Each correction is held by more names than the
    # word, or is known and held by as many, so that doubling the steps ends.
    while True:
        further = once.select(F.col("token").alias("_right"), F.col("_right").alias("_then"))
        if once.join(further, "_right", "left_semi").isEmpty():
            return once
        once = checkpoint(once.join(further, "_right", "left").select("token", F.coalesce("_then", "_right").alias("_right")))


def short_forms(words: list[str]) -> set[str]:
    """Initials of a body's words, small words in or out."""
    choices = [("", w[0]) if w in SMALL else (w[0],) for w in words]
    if not words or len(words) > 9:
        return set()
    return {"".join(c) for c in itertools.product(*choices)} - {w for w in words if len(w) < 2}


def profile(name: str, tokens: list[str], places: list[bool]) -> dict:
    """What a name tells: of a body ``place, level, words, short``, of a person ``surname, given, middle``."""
    is_place = dict(zip(tokens, places, strict=True))
    level = next((t for t in tokens if t in LEVELS), "")
    spots = [t for t in tokens if is_place[t]]
    out = {"place": "", "level": level, "words": [], "natural": [], "short": "", "surname": "", "given": "", "middle": ""}
    if spots or level:
        out["place"] = spots[0] if spots else ""
        rest = [t for t in tokens if t not in LEVELS and t != out["place"]]
        out["natural"] = _natural(name, rest)
        out["words"] = sorted({t for t in rest if t not in SMALL})
        if len(out["words"]) == 1 and len(out["words"][0]) <= 6 and len(rest) == 1:
            out["short"] = out["words"][0]
        return out
    people = [t for t in tokens if t not in TITLES]
    if not 2 <= len(people) <= 4 or any(t in SMALL and len(t) > 1 for t in people):
        out["words"] = sorted({t for t in tokens if t not in SMALL})
        return out
    first, *others = people
    if "," in name and not re.search(r",\s*(?:jr|sr|ph\.?d|m\.?d|esq)\.?\s*$", name.lower()):
        cut = len(tokens_of(name.split(",")[0]))
        people = people[cut:] + people[:cut]
        first, *others = people
    called = set(NICKNAMES) | set(FORMAL)
    if others[-1] in called and first not in called:  # surname first, without a comma
        first, others = others[-1], [*others[:-1], first]
    out["surname"], out["given"] = others[-1], first
    out["middle"] = others[0][0] if len(others) > 1 else ""
    return out


def _natural(name: str, rest: list[str]) -> list[str]:
    """The words in speaking order, where the name does not turn them round."""
    return rest if not re.search(r",\s*\w+ (?:of|for)\b", name.lower()) else []


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for name, tokens, places in zip(batch["_name"], batch["_tokens"], batch["_places"], strict=True):
            p = profile(name, list(tokens), [bool(x) for x in places])
            person = p["surname"] != ""
            formal = sorted(set(FORMAL.get(p["given"], [])) | ({p["given"]} if len(p["given"]) > 1 else set()))
            rows.append(
                {
                    "_name": name,
                    "person": person,
                    "place": p["surname"] if person else p["place"],
                    "level": p["level"],
                    "words": [] if person else p["words"],
                    "short": p["given"] if person else p["short"],
                    "forms": formal if person else sorted(short_forms(p["natural"])),
                    "middle": p["middle"],
                }
            )
        yield pd.DataFrame(rows, columns=["_name", "person", "place", "level", "words", "short", "forms", "middle"])


_PROFILE = "_name string, person boolean, place string, level string, words array<string>, short string, forms array<string>, middle string"


def name_profiles(names: DataFrame, short_words: Mapping[str, str] | None = None) -> DataFrame:
    """One profile a distinct name in ``_name``: words spelled out and corrected, places told from their company."""
    split = checkpoint(names.mapInPandas(_tokenise, "_name string, _tokens array<string>"))
    words = split.select("_name", F.posexplode("_tokens").alias("_pos", "token"))
    if short_words:
        given = words.sparkSession.createDataFrame(sorted(short_words.items()), "token string, _long string")
        words = _spelled_out(words, given)
    # Names with two short words agree with others once the first is spelled out, misspelt ones once they are corrected.
    for _ in range(2):
        words = _spelled_out(words, learned_short_words(words))
    right = corrections(words)
    fixed = words.join(right, "token", "left").select("_name", "_pos", F.coalesce("_right", "token").alias("token"))
    fixed = checkpoint(fixed)
    fixed = _spelled_out(fixed, learned_short_words(fixed))
    # A place stands before its level, or after "level of".
    levels = sorted(LEVELS)
    line = fixed.groupBy("_name").agg(F.array_sort(F.collect_list(F.struct("_pos", "token"))).alias("_line"))
    line = line.select("_name", F.transform("_line", lambda x: x["token"]).alias("_tokens"))
    beside = F.transform(
        "_tokens",
        lambda t, i: F.struct(
            t.alias("token"),
            (
                F.get("_tokens", i + 1).isin(levels)
                | (F.get("_tokens", i - 1).eqNullSafe("of") & F.get("_tokens", i - 2).isin(levels))
            ).alias("_beside"),
        ),
    )
    marked = line.select("_name", F.explode(beside).alias("x")).select("_name", "x.token", F.coalesce("x._beside", F.lit(False)).alias("_beside"))
    places = (
        marked.groupBy("token")
        .agg(F.count_if("_beside").alias("b"), F.count("*").alias("n"))
        .where((F.col("b") * 3 >= F.col("n")) & (F.length("token") > 2) & ~F.col("token").isin(sorted(SMALL | LEVELS | HEADS)))
        .select("token", F.lit(True).alias("_place"))
    )
    told = (
        fixed.join(places, "token", "left")
        .groupBy("_name")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "token", F.coalesce("_place", F.lit(False)).alias("p")))).alias("_line"))
        .select("_name", F.transform("_line", lambda x: x["token"]).alias("_tokens"), F.transform("_line", lambda x: x["p"]).alias("_places"))
    )
    return told.mapInPandas(_profiles, _PROFILE)


def _merged(entities: DataFrame) -> DataFrame:
    """Profiles of one entity made one: spellings, words, initials and short forms united."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return entities.groupBy("entity").agg(
        F.max("person").alias("person"),
        F.max("place").alias("place"),
        F.max("level").alias("level"),
        flat("words").alias("words"),
        flat("forms").alias("forms"),
        F.max("middle").alias("middle"),
        F.max("complete").alias("complete"),
        F.array_sort(F.collect_set(F.when(F.col("short") != "", F.col("short")))).alias("shorts"),
    )


def resolve_names(values: DataFrame, name: str, *, short_words: Mapping[str, str] | None = None) -> DataFrame:
    """``name, entity``: every distinct string and the entity that it names.

    Strings are kept as stored; null and blank ones name nothing and are left out, repeated ones count once. A name
    without a partner is its own entity. Rounds go on until one merges nothing; each lowers the number of entities.
    ``short_words`` are abbreviations known beforehand; without them they are learned from the names. An empty table
    gives no rows; other columns are dropped.
    """
    names = values.select(F.col(name).alias("_name")).where(F.col("_name").rlike(r"[\p{L}\p{N}]")).distinct()
    profiles = checkpoint(name_profiles(names, short_words))
    person = F.col("person")
    whole_person = person & (F.length("short") > 1) & (F.size("forms") == 1)
    headed = F.exists("words", lambda w: w.isin(sorted(HEADS)))
    whole_body = ~person & (F.col("place") != "") & (F.col("level") != "") & (F.size("words") > 1) & headed
    key = F.when(
        person, F.concat_ws("|", F.lit("p"), "place", F.when(F.size("forms") == 1, F.element_at("forms", 1)).otherwise(F.concat(F.lit("?"), F.col("short"))))
    ).otherwise(F.concat_ws("|", F.lit("b"), "place", "level", F.concat_ws(" ", "words")))
    current = checkpoint(
        profiles.withColumn("entity", F.md5(key)).withColumn("complete", (whole_person | whole_body).cast("int"))
    )
    while True:
        moves = checkpoint(_rematch(_merged(current)))
        if moves.isEmpty():
            break
        current = checkpoint(
            current.join(moves, "entity", "left")
            .withColumn("entity", F.coalesce("_into", "entity"))
            .withColumn("complete", F.when(F.col("_into").isNotNull(), 1).otherwise(F.col("complete")))
            .drop("_into")
        )
    return current.select(F.col("_name").alias(name), "entity")


def _line(words: Column, level: Column) -> Column:
    """The words of a body and its level, in order."""
    return F.array_sort(F.filter(F.concat(words, F.array(level)), lambda w: w != ""))


def _initials(words: Column, level: Column) -> Column:
    """A key of the first letters of a body's words and level."""
    return F.concat(F.lit("#"), F.array_join(F.transform(_line(words, level), lambda w: F.substring(w, 1, 1)), ""))


#: First letters that a word and a shorter form of it have in common.
START = 4


def _starts(words: Column) -> Column:
    """Keys of the first letters of the longer words."""
    return F.transform(F.filter(words, lambda w: F.length(w) >= START), lambda w: F.concat(F.lit("~"), F.left(w, F.lit(START))))


def _in_order(word: Column) -> Column:
    """A pattern of the words that have all letters of this one in order, from the first on."""
    return F.concat(F.lit("^"), F.regexp_replace(word, "(.)", "$1.*"))


def _rematch(entities: DataFrame) -> DataFrame:
    """``entity, _into``: incomplete profiles with the only profile they can mean."""
    e = checkpoint(entities)
    whole = e.where("complete = 1").select(
        F.col("entity").alias("_into"), "person", "place", F.col("level").alias("_level"), F.col("words").alias("_words"),
        F.col("forms").alias("_forms"), F.col("middle").alias("_middle"),
    )
    part = e.where("complete = 0").withColumn("short", F.get("shorts", F.lit(0)))
    # Keys under which a complete body can be asked for: its short forms and each of its words; a person's given name
    # and initial. One-word profiles ask under the word and as a short form.
    body_keys = F.array_distinct(F.concat("_forms", "_words", F.array(_initials(F.col("_words"), F.col("_level"))), _starts(F.col("_words"))))
    person_keys = F.flatten(F.transform("_forms", lambda f: F.array(f, F.substring(f, 1, 1))))
    offered = whole.withColumn("_key", F.explode(F.when(F.col("person"), F.array_distinct(person_keys)).otherwise(body_keys)))
    wanted = part.withColumn(
        "_key",
        F.explode_outer(
            F.when(F.col("person") & (F.length("short") == 1), F.array("short"))
            .when(F.col("person"), F.col("forms"))
            .otherwise(
                F.concat(
                    F.slice(F.array_sort("words", lambda a, b: F.length(b) - F.length(a)), 1, 1),
                    F.array(_initials(F.col("words"), F.col("level"))),
                    F.slice(_starts(F.array_sort("words", lambda a, b: F.length(b) - F.length(a))), 1, 1),
                )
            )
        ),
    )
    level_fits = (F.col("level") == "") | (F.col("level") == F.col("_level"))
    subset = F.size(F.array_except("words", "_words")) == 0
    short_fits = (F.size("words") == 1) & F.exists("_forms", lambda f: f == F.get("words", F.lit(0)))
    aligned = F.forall(
        F.arrays_zip(_line(F.col("words"), F.col("level")).alias("a"), _line(F.col("_words"), F.col("_level")).alias("b")),
        lambda x: F.coalesce((x["a"] == x["b"]) | ((F.length(x["a"]) > 1) & F.rlike(x["b"], _in_order(x["a"]))), F.lit(False)),
    )
    begun = F.forall(
        "words",
        lambda w: F.exists(
            "_words",
            lambda v: (w == v) | ((F.length(w) >= START) & (F.left(w, F.lit(START)) == F.left(v, F.lit(START)))
            & (F.rlike(v, _in_order(w)) | v.startswith(F.left(w, F.length(w) - 3)))),
        ),
    )
    middle_fits = (F.col("middle") == "") | (F.col("_middle") == "") | (F.col("middle") == F.col("_middle"))
    fits = F.when(F.col("person"), middle_fits).otherwise(level_fits & (subset | short_fits | aligned | begun))
    # Equal words beat a subset of them, and these beat words that may be short for others.
    rank = F.when(F.col("person"), F.when((F.col("middle") != "") & (F.col("middle") == F.col("_middle")), 0).otherwise(1)).otherwise(
        F.when(subset & (F.size(F.array_except("_words", "words")) == 0), 0).when(subset | short_fits, 1).when(aligned, 2).otherwise(3)
    )
    found = (
        wanted.join(offered, ["person", "place", "_key"])
        .where(fits)
        .select("entity", "_into", rank.alias("_rank"))
        .groupBy("entity", "_into")
        .agg(F.min("_rank").alias("_rank"))
    )
    best = found.groupBy("entity").agg(F.min("_rank").alias("_rank"))
    top = found.join(best, ["entity", "_rank"]).groupBy("entity").agg(F.count("*").alias("n"), F.min("_into").alias("_into"))
    return top.where("n = 1").select("entity", "_into")


def variant_pairs(members: DataFrame, name: str) -> DataFrame:
    """``name_a, name_b``: all pairs of different spellings of an entity, by code point."""
    a = members.select("entity", F.col(name).alias("name_a"))
    b = members.select("entity", F.col(name).alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
