"""Times written in many formats and zones into one instant each.

Every value is read by a small set of format families, all built-in expressions. A numeric date whose order is open is
read both ways; each source (portal) is then a mixture of the two orders, whose weights are fitted by expectation and
maximisation on the counts of its values (those that only one order can read, those that both can). The declared order
of the source is the prior. Posteriors choose the reading; what they leave open is marked, not guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.functions.cleaning import squeeze
from lexistrata.functions.text import lookup

#: Month names of four languages, lower case, without full stops.
MONTHS = {
    1: "january jan januar jän jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fevr febrero",
    3: "march mar märz maerz mrz mär mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre set",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
#: Offsets of zone abbreviations in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "cest": 120, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "awst": 480, "acst": 570, "acdt": 630, "aest": 600,
    "aedt": 660, "nzst": 720, "nzdt": 780, "ast": -240, "adt": -180, "nst": -210, "ndt": -150, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?: ?([ap])\.?m\.?(?![a-z]))?"
_ZONE = r"(?: ?(z|[+-]\d{2}(?::?\d{2})?|(?!am\b|pm\b|uhr\b)[a-z]{2,5}|[a-z]+(?:/[a-z_+-]+\d*){1,2}))?(?: ?\[([a-z_/+-]+\d*)\])?"
_CLOCK = rf"(?:(?:,? ?t|,? (?:à |at |um |a las )?|, ?){_TIME}{_HALF}(?: ?uhr)?{_ZONE})?"
_WORD = r"([^\W\d_]+)"
#: Format families, each with the places of year, month, day (0: absent); the clock's six groups come after those.
FAMILIES = {
    "year first": (rf"^(\d{{4}})([-/.])(\d{{1,2}})(?:\2(\d{{1,2}}){_CLOCK})?$", 4, (1, 3, 4)),
    "day month name": (
        rf"(?U)^(?:{_WORD}\.?,? )?(\d{{1,2}})(?:\.|er|st|nd|rd|th)?[ -](?:de )?{_WORD}\.?,?[ -](?:de )?(\d{{4}}){_CLOCK}$",
        4,
        (4, 3, 2),
    ),
    "month name day": (
        rf"(?U)^(?:{_WORD}\.?, )?{_WORD}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_CLOCK}$",
        4,
        (4, 2, 3),
    ),
    "month name year": (rf"(?U)^{_WORD}\.?,? (?:de )?(\d{{4}})$", 2, (2, 1, 0)),
}
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?(?: ?(z|[+-]\d{2}(?::?\d{2})?))?)?$"
_NUMERIC = rf"^(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_CLOCK}$"
_EPOCH = r"^(-?\d{9,10}|-?\d{12,13}|-?\d{15,16})(?:[.,](\d+))?$"


def _int(text: Column) -> Column:
    return F.expr("int(null)") if text is None else F.nullif(text, F.lit("")).try_cast("int")


def _group(text: Column, pattern: str, place: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, place), F.lit("")) if place else F.lit(None).cast("string")


def _lookup(pairs: dict[str, int], key: Column) -> Column:
    return lookup({name: str(number) for name, number in pairs.items()}, key).cast("int")


def _month(word: Column) -> Column:
    names = {name: number for number, all_names in MONTHS.items() for name in all_names.split()}
    return _lookup(names, word)


def _local_micros(year: Column, month: Column, day: Column, clock: Column) -> Column:
    """Microseconds of a local date and time as if it were UTC; null where the date or time does not exist."""
    hour = (
        F.when(clock["half"].isNull(), clock["hour"])
        .when((clock["hour"] < 1) | (clock["hour"] > 12), clock["hour"])
        .when(clock["half"] == "p", F.pmod(clock["hour"], F.lit(12)) + 12)
        .otherwise(F.pmod(clock["hour"], F.lit(12)))
    )
    second = F.coalesce(clock["second"], F.lit(0))
    stamp = F.try_make_timestamp(
        year, month, F.coalesce(day, F.lit(1)), hour, clock["minute"], second.cast("decimal(16,6)"), F.lit("UTC")
    )
    return F.unix_micros(stamp) + F.rpad(F.substring(F.coalesce(clock["fraction"], F.lit("0")), 1, 6), 6, "0").cast("long")


def _clock(text: Column, pattern: str, start: int) -> Column:
    """Time of day and zone from the six groups after ``start``."""
    hour, minute, second, fraction, half, zone, region = (
        _group(text, pattern, start + place) for place in range(1, 8)
    )
    return F.struct(
        F.coalesce(_int(hour), F.lit(0)).alias("hour"),
        F.coalesce(_int(minute), F.lit(0)).alias("minute"),
        _int(second).alias("second"),
        fraction.alias("fraction"),
        half.alias("half"),
        F.coalesce(zone, region).alias("zone"),
    )


def _known_zones(spark: SparkSession) -> list[str]:
    return sorted(spark._jvm.java.time.ZoneId.getAvailableZoneIds())


def readings(df: DataFrame, text: str, tz: str) -> DataFrame:
    """Adds ``_family`` and the local readings ``_first`` (the only one, or month first) and ``_second`` (day first).

    Both are UTC microseconds or null. ``tz`` names the column with the zone for texts that state none.
    """
    spark = df.sparkSession
    s = F.lower(squeeze(F.col(text)))
    df = df.withColumn("_s", s)
    s = F.col("_s")
    branches: list[tuple[str, Column, Column]] = []
    for family, (pattern, before, (y, m, d)) in FAMILIES.items():
        month = _group(s, pattern, m)
        branches.append(
            (
                family,
                s.rlike(pattern),
                F.struct(
                    _int(_group(s, pattern, y)).alias("year"),
                    (_month(month) if "name" in family else _int(month)).alias("month"),
                    _int(_group(s, pattern, d)).alias("day"),
                    _clock(s, pattern, before).alias("clock")
                    if family != "month name year"
                    else _clock(s, r"^()()()()()()()$", 0).alias("clock"),
                ),
            )
        )
    compact = F.struct(
        _int(_group(s, _COMPACT, 1)).alias("year"),
        _int(_group(s, _COMPACT, 2)).alias("month"),
        _int(_group(s, _COMPACT, 3)).alias("day"),
        F.struct(
            F.coalesce(_int(_group(s, _COMPACT, 4)), F.lit(0)).alias("hour"),
            F.coalesce(_int(_group(s, _COMPACT, 5)), F.lit(0)).alias("minute"),
            _int(_group(s, _COMPACT, 6)).alias("second"),
            _group(s, _COMPACT, 7).alias("fraction"),
            F.lit(None).cast("string").alias("half"),
            _group(s, _COMPACT, 8).alias("zone"),
        ).alias("clock"),
    )
    year = F.regexp_extract(s, _NUMERIC, 4)
    numeric = F.struct(
        _int(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)).alias("year"),
        _int(_group(s, _NUMERIC, 1)).alias("month"),
        _int(_group(s, _NUMERIC, 3)).alias("day"),
        _clock(s, _NUMERIC, 4).alias("clock"),
    )
    digits = F.regexp_extract(s, _EPOCH, 1)
    scale = F.when(F.length(F.ltrim(digits, F.lit("-"))) <= 10, 1_000_000).when(F.length(F.ltrim(digits, F.lit("-"))) <= 13, 1_000).otherwise(1)
    epoch = digits.try_cast("long") * scale + F.when(
        scale == 1_000_000, F.rpad(F.substring(F.coalesce(_group(s, _EPOCH, 2), F.lit("0")), 1, 6), 6, "0").cast("long")
    ).otherwise(0)
    branches.append(("compact", s.rlike(_COMPACT) & ~s.rlike(_EPOCH), compact))
    branches.append(("numeric", s.rlike(_NUMERIC), numeric))
    family, fields = None, None
    for name, test, parts in branches:
        family = F.when(test, name) if family is None else family.when(test, name)
        fields = F.when(test, parts) if fields is None else fields.when(test, parts)
    df = df.withColumn("_family", F.when(s.rlike(_EPOCH), "epoch").otherwise(family)).withColumn("_p", fields)
    p = F.col("_p")
    first = _local_micros(p["year"], p["month"], p["day"], p["clock"])
    second = F.when(F.col("_family") == "numeric", _local_micros(p["year"], p["day"], p["month"], p["clock"]))
    zone = p["clock"]["zone"]
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    numbers = F.regexp_extract(zone, r"^[+-](\d{2}):?(\d{2})?$", 1), F.regexp_extract(zone, r"^[+-](\d{2}):?(\d{2})?$", 2)
    offset = F.coalesce(
        F.when(zone.rlike(r"^[+-]"), sign * (_int(numbers[0]) * 60 + F.coalesce(_int(numbers[1]), F.lit(0)))),
        _lookup(ABBREVIATIONS, zone),
    )
    ids = _known_zones(spark)
    known = {name.lower(): name for name in ids}
    named, own = lookup(known, zone), lookup(known, F.lower(F.col(tz)))
    df = (
        df.withColumn("_first", first)
        .withColumn("_second", second)
        .withColumn("_offset", offset)
        .withColumn("_zone", F.when(zone.isNull(), own).otherwise(named))
    )

    def instant(local: Column) -> Column:
        there = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("_zone")))
        return F.when(F.col("_offset").isNotNull(), local - F.col("_offset").cast("long") * 60_000_000).when(
            F.col("_zone").isNotNull(), there
        )

    return (
        df.withColumn(
            "_first", F.when(F.col("_family") == "epoch", epoch).otherwise(instant(F.col("_first")))
        )
        .withColumn("_second", instant(F.col("_second")))
        .drop("_s", "_p", "_offset", "_zone")
    )


def order_weights(read: DataFrame, source: str, declared: str, *, prior: float = 1e6, rounds: int = 40) -> DataFrame:
    """The weight of month-first order in each source, by expectation and maximisation.

    ``declared`` (``MDY``, ``DMY`` or null) is worth ``prior`` observations. The mixture has two components; values
    that both orders read count by their responsibility, which a fixed number of rounds refines. One row a source.
    """
    both = F.col("_first").isNotNull() & F.col("_second").isNotNull() & (F.col("_first") != F.col("_second"))
    counts = (
        read.where(F.col("_family") == "numeric")
        .groupBy(source)
        .agg(
            F.count_if(F.col("_first").isNotNull() & F.col("_second").isNull()).cast("double").alias("m"),
            F.count_if(F.col("_first").isNull() & F.col("_second").isNotNull()).cast("double").alias("d"),
            F.count_if(both).cast("double").alias("b"),
            F.max(declared).alias("order"),
        )
    )
    m = F.col("m") + F.when(F.col("order") == "MDY", prior).otherwise(0.5)
    d = F.col("d") + F.when(F.col("order") == "DMY", prior).otherwise(0.5)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        m / (m + d),
        lambda weight, _: (m + F.col("b") * weight) / (m + d + F.col("b")),
    )
    return counts.select(source, step.alias("_weight"))


def normalise_times(
    df: DataFrame,
    text: str,
    source: str,
    tz: str,
    declared: str,
    *,
    decided: float = 0.9,
) -> DataFrame:
    """Adds ``utc_micros``, ``family``, ``posterior`` and ``ambiguous`` to rows of times as text.

    Null, blank and unreadable texts and dates that do not exist get null. A text without a zone is local time of
    ``tz``; without one it stays null. Of a local time that occurs twice the earlier instant is taken, one that was
    skipped moves on by the gap. A numeric date that both orders read is ``ambiguous``, with null, where neither order
    reaches the posterior ``decided`` (no declared order and no telling values in its source). Repeated rows and other
    columns are kept; a source may hold any share of the rows, as only its counts are gathered.
    """
    read = readings(df, text, tz)
    weights = order_weights(read, source, declared)
    joined = read.join(weights.withColumnRenamed(source, "_source"), read[source].eqNullSafe(F.col("_source")), "left")
    weight = F.col("_weight")
    open_order = F.col("_first").isNotNull() & F.col("_second").isNotNull() & (F.col("_first") != F.col("_second"))
    one = F.coalesce(F.col("_first"), F.when(F.col(declared).isNull() | (F.col(declared) != "MDY"), F.col("_second")))
    only_first = F.col("_family").eqNullSafe("numeric") & F.col("_second").isNull() & F.col(declared).eqNullSafe("DMY")
    chosen = (
        F.when(open_order & (weight >= decided), F.col("_first"))
        .when(open_order & (weight <= 1 - decided), F.col("_second"))
        .when(~open_order & ~only_first, one)
    )
    return (
        joined.withColumn("utc_micros", chosen)
        .withColumn("family", F.col("_family"))
        .withColumn("posterior", F.when(open_order, F.greatest(weight, 1 - weight)).when(chosen.isNotNull(), 1.0))
        .withColumn("ambiguous", open_order & chosen.isNull())
        .drop("_family", "_first", "_second", "_weight", "_source")
    )
