"""Free-entered values led to the entry of a canonical list that they mean.

Other names of an entry are learned from what stands beside them in another field (``learned_forms``). Every form of the list
(labels, codes, other names) is indexed under the texts left after deleting up to two of its
first characters (symmetric deletes); a value is looked up under its own deletes, so that all forms within a bounded edit
distance are found by equality. The index grows with the list, not with the data; it is counted and broadcast only below
a bound, else joined by hash. Candidates are ranked by weighted Damerau-Levenshtein distance, then by how often the
entry occurs exactly in the data. Values without an entry are reported as entry 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexistrata.engine import checkpoint
from lexistrata.functions.cleaning import clean

PREFIX = 10
MOST_BROADCAST = 200_000

#: Other names of file formats, by label of the reference list; only for those who ask for them.
ALIASES = {
    "CSV": "comma separated values|comma-separated text|comma delimited file|comma delimited|comma separated|csv utf-8"
    "|application/csv|text/x-csv|application/x-csv|text/comma-separated-values",
    "TSV": "tab separated values|tab delimited text|tab delimited|tab separated text|text/tsv|application/tsv",
    "XLSX": "excel workbook 2016|office open xml spreadsheet|ms excel (xlsx)|excel workbook|excel 2007|excel (xlsx)|excel",
    "XLS": "excel 97-2003|ms excel (xls)|excel (xls)|application/x-msexcel-xls|application/x-msexcel|application/msexcel"
    "|application/x-excel|application/excel",
    "ODS": "opendocument spreadsheet|open document spreadsheet",
    "JSON": "javascript object notation|plain json|text/json|application/x-json",
    "GeoJSON": "geo json|geo-json features|geojson features|application/vnd.geo+json",
    "JSON-LD": "json ld|json linked data|linked data json",
    "NDJSON": "newline delimited json|json lines|jsonl|application/jsonl|application/ndjson|application/x-jsonlines",
    "XML": "extensible markup language|xml document|text/xml",
    "RDF/XML": "rdf xml|resource description framework xml|resource description framework",
    "Turtle": "rdf turtle|terse rdf triple language|application/x-turtle|application/turtle",
    "N-Triples": "ntriples|rdf n triples|text/n-triples",
    "KML": "keyhole markup language|kml layer",
    "KMZ": "zipped kml|keyhole markup zipped|compressed kml",
    "Shapefile": "shape file|esri shapefile|esri shape file|shapefile (zipped)|zipped shapefile|application/x-shapefile"
    "|application/x-esri-shape",
    "GML": "geography markup language",
    "GeoPackage": "geo package|ogc geopackage",
    "File Geodatabase": "file gdb|filegdb|esri file geodatabase|esri geodatabase|geodatabase",
    "GeoTIFF": "geo tiff|geo tiff raster|georeferenced tiff|image/tiff|image/geotiff|tiff|tif",
    "NetCDF": "net cdf|network common data form|application/netcdf",
    "HDF5": "hdf 5|hierarchical data format 5|hierarchical data format|application/hdf5|hdf",
    "PDF": "portable document format|portable document|adobe acrobat pdf|adobe acrobat|acrobat|adobe pdf|application/x-pdf",
    "DOCX": "word document 2016|ms word (docx)|word document|office open xml document",
    "DOC": "word 97-2003|ms word (doc)|application/vnd.ms-word|application/x-msword",
    "ODT": "opendocument text|open document text",
    "HTML": "hypertext markup language|web page (html)|web page|html page|application/xhtml+xml|xhtml|htm",
    "TXT": "plain text|ascii text file|ascii text|text file",
    "ZIP": "zip archive|zip compressed folder|zip compressed|application/x-zip-compressed|application/x-zip",
    "GZIP": "gnu zip|gzip compressed|application/x-gzip",
    "7Z": "7-zip archive|7-zip|7zip|seven zip archive|seven zip",
    "TAR": "tarball|tape archive tar|tape archive|tar archive",
    "API": "rest api|api endpoint|web service api|web api",
    "WMS": "web map service|ogc wms",
    "WFS": "web feature service|ogc wfs",
    "WMTS": "web map tile service|ogc wmts",
    "Esri REST": "arcgis rest service|arcgis rest|arcgis geoservices rest api|arcgis feature server|arcgis map server"
    "|arcgis map service|esri rest service",
    "SQLite": "sqlite database|sqlite 3|sqlite3|application/x-sqlite3|application/x-sqlite",
    "Parquet": "apache parquet|parquet columnar file|parquet columnar|application/parquet|application/x-parquet",
    "Avro": "apache avro|avro binary|application/x-avro",
    "PNG": "portable network graphics|png image",
    "JPEG": "jpeg photo|jpeg image|jpg image|image/pjpeg|image/jpg",
    "PPTX": "powerpoint presentation|ms powerpoint (pptx)|powerpoint",
    "RSS": "rss feed|rss newsfeed|really simple syndication",
    "Atom": "atom feed|atom syndication",
    "iCalendar": "ical calendar|icalendar feed|ical|calendar feed",
    "GPX": "gps exchange format|gps exchange",
    "DBF": "dbase table|dbase file|dbase|application/dbf|application/dbase",
    "SPSS": "spss statistics data|spss sav|spss statistics|spss data file|application/x-spss",
    "Stata": "stata dataset|stata data file|stata data|application/x-stata",
}


def normal_form(value: Column) -> Column:
    """Lower case, one kind of separator, no wrapping signs, no charset, no address before a media type."""
    v = clean(value)
    v = F.regexp_replace(v, r"^https?://\S*?/((?:text|application|image|audio|video|multipart|model)/)", "$1")
    v = F.regexp_replace(v, r"\s*;\s*charset\s*=.*$", "")
    v = F.regexp_replace(v, r"\s*[\\/]+\s*", "/")
    v = F.regexp_replace(v, r"[-_+\s()\[\]{}]+", " ")
    return F.regexp_replace(v, r"^[\s.*;,:!?'\"/]+|[\s.*;,:!?'\"/]+$", "")


def forms(value: Column) -> Column:
    """The normal forms to try, most literal first: whole, without a trailing bracket, that bracket, without filler."""
    bracket = r"^(.*\S)\s*\[([^\[\]]+)\]\s*$"
    whole = normal_form(value)
    head = normal_form(F.regexp_replace(value, bracket, "$1"))
    inner = F.when(value.rlike(bracket), normal_form(F.regexp_extract(value, bracket, 2)))
    bare = F.regexp_replace(head, r" (?:format|file|files|download|document|data|dataset)$", "")
    return F.array_distinct(F.filter(F.array(whole, inner, head, bare), lambda f: F.length(f) > 0))


def deletes(form: Column, most: Column | int = 2) -> Column:
    """The first characters of a text and what is left of them after up to two deletes."""
    start = F.substring(form, 1, PREFIX)

    def without_one(text: Column) -> Column:
        return F.when(
            F.length(text) > 0,
            F.transform(
                F.sequence(F.lit(1), F.length(text)),
                lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.lit(PREFIX))),
            ),
        ).otherwise(F.array().cast("array<string>"))

    one = without_one(start)
    two = F.flatten(F.transform(one, without_one))
    most = F.lit(most) if isinstance(most, int) else most
    return F.array_distinct(
        F.concat(
            F.array(start),
            F.when(most >= 1, one).otherwise(F.array().cast("array<string>")),
            F.when(most >= 2, two).otherwise(F.array().cast("array<string>")),
        )
    )


def allowed_edits(length: Column) -> Column:
    """Short texts must match exactly: 0 edits below 5 characters, 1 below 14, else 2."""
    return F.when(length < 5, 0).when(length < 14, 1).otherwise(2)


def weighted_distance(a: str, b: str, most: int) -> float | None:
    """Damerau-Levenshtein distance with cheap swaps and doubled letters, or none if over ``most`` plain edits."""
    found = weighted_distances([a], [b], [most])[0]
    return None if np.isnan(found) else float(found)


#: An edit outweighs any sum of weights, so that the fewest edits come first and of those the least weight.
_EDIT = 4096.0


def _letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    table = np.zeros((len(texts), sizes.max(initial=0) + 1), np.uint32)
    table[np.arange(table.shape[1])[None, :] < sizes[:, None]] = flat
    return table, sizes


def weighted_distances(left: Sequence[str], right: Sequence[str], most: Sequence[int]) -> np.ndarray:
    """``weighted_distance`` of many pairs at once, not a number where it is over: a row of all pairs' tables at a time."""
    out = np.full(len(left), np.nan)
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)]).reshape(-1, 2)
    near = np.flatnonzero(np.abs(sizes[:, 0] - sizes[:, 1]) <= np.asarray(most))
    order = near[np.argsort(sizes[near].max(axis=1), kind="stable")]
    first = 0
    while first < len(order):
        # Pairs of like lengths share a table of bounded size.
        last = first + 1
        while last < len(order) and (last - first) * (sizes[order[last]].max() + 1) <= 200_000:
            last += 1
        some = order[first:last]
        out[some] = _distances([left[i] for i in some], [right[i] for i in some])
        first = last
    edits = np.floor(out / _EDIT)
    return np.where(edits <= np.asarray(most), np.round(out - edits * _EDIT, 6), np.nan)


def _distances(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    a, na = _letters(left)
    b, nb = _letters(right)
    wide = b.shape[1]
    twice_b = np.zeros(b.shape, bool)
    twice_b[:, 1:] = b[:, 1:] == b[:, :-1]
    rows = [np.tile(np.arange(wide) * (_EDIT + 1), (len(left), 1))]
    out = np.where(na == 0, rows[0][np.arange(len(left)), nb], 0.0)
    for i in range(1, a.shape[1]):
        letter, before = a[:, i - 1], a[:, i - 2] if i > 1 else None
        up = rows[-1] + _EDIT + (np.where(letter == before, 0.7, 1.0)[:, None] if i > 1 else 1.0)
        row = np.empty_like(rows[-1])
        row[:, 0] = i * (_EDIT + 1)
        for j in range(1, wide):
            same = letter == b[:, j - 1]
            best = np.minimum(up[:, j], rows[-1][:, j - 1] + np.where(same, 0.0, _EDIT + (1.0 if i > 1 and j > 1 else 1.2)))
            best = np.minimum(best, row[:, j - 1] + _EDIT + np.where(twice_b[:, j - 1] if j > 1 else False, 0.7, 1.0))
            if i > 1 and j > 1:
                swapped = (letter == b[:, j - 2]) & (before == b[:, j - 1])
                best = np.where(swapped, np.minimum(best, rows[-2][:, j - 2] + _EDIT + 0.8), best)
            row[:, j] = best
        rows = [rows[-1], row]
        ended = na == i
        out[ended] = row[ended, nb[ended]]
    return out


@F.pandas_udf(DoubleType())
def _distance(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series(weighted_distances(a.tolist(), b.tolist(), most.to_numpy()))


def reference_forms(reference: DataFrame, entry_id: str, columns: Sequence[str], aliases: DataFrame | None) -> DataFrame:
    """``entry, form`` of every written form of the list; of a form that two entries share, the smaller entry's."""
    named = reference.select(
        F.col(entry_id).cast("int").alias("entry"), F.explode(F.array(*(F.col(c) for c in columns))).alias("name")
    )
    if aliases is not None:
        named = named.unionByName(aliases.select(F.col("entry").cast("int"), "name"))
    return (
        named.select("entry", normal_form(F.col("name")).alias("form"))
        .where(F.length("form") > 0)
        .groupBy("form")
        .agg(F.min("entry").alias("entry"))
    )


def alias_table(reference: DataFrame, entry_id: str, label: str, names: Mapping[str, str] = ALIASES) -> DataFrame:
    """``entry, name`` of other names that are known beforehand, by label, several parted by bars."""
    known = F.create_map(*[F.lit(x) for key, value in names.items() for x in (key.lower(), value)])
    found = F.try_element_at(known, F.lower(F.col(label)))
    return reference.select(F.col(entry_id).alias("entry"), F.explode(F.split(found, r"\|")).alias("name"))


def learned_forms(beside: DataFrame, dictionary: DataFrame, *, support: int = 4, share: float = 0.8) -> DataFrame:
    """``entry, form`` of other names that the data teach: forms that stand beside values of one entry.

    ``beside`` has ``value, other``: what was typed for a thing, and what else was typed for the same thing in another
    field. A form that the dictionary lacks is a name of an entry if at least ``support`` others beside it are forms of
    the dictionary and at least ``share`` of these are that entry's. Counts are combined before they are shuffled.
    """
    counted = beside.where("value is not null and other is not null").groupBy("value", "other").agg(F.count("*").alias("n"))
    counted = checkpoint(counted)
    others = counted.select("other").distinct().select("other", F.posexplode(forms(F.col("other"))).alias("_rank", "form"))
    meant = others.join(_small(dictionary), "form").groupBy("other").agg(F.min_by("entry", "_rank").alias("entry"))
    named = counted.join(meant, "other").groupBy("value", "entry").agg(F.sum("n").alias("n"))
    tried = named.select("entry", "n", F.explode(forms(F.col("value"))).alias("form")).groupBy("form", "entry").agg(F.sum("n").alias("n"))
    told = tried.groupBy("form").agg(F.sum("n").alias("all"), F.max_by("entry", F.struct("n", (-F.col("entry")).alias("e"))).alias("entry"), F.max("n").alias("top"))
    sure = told.where((F.col("all") >= support) & (F.col("top") >= share * F.col("all")) & F.col("form").rlike(r"\p{L}"))
    return sure.join(_small(dictionary), "form", "left_anti").select("entry", "form")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def map_values(values: DataFrame, value: str, dictionary: DataFrame) -> DataFrame:
    """The entry meant by every distinct non-blank string: ``value, occurrences, entry, distance``; entry 0 if none.

    ``dictionary`` has ``entry, form``. Null, empty and blank values are left out; repeated values are counted once for
    each row. Ties in distance go to the entry that occurs more often exactly in ``values``, then to the smaller entry.
    Very long values are looked up by their first characters and verified whole. An empty ``values`` gives no rows.
    Other columns are dropped first.
    """
    distinct = (
        values.select(F.col(value).alias("value"))
        .where(F.length(clean(F.col("value"))) > 0)
        .groupBy("value")
        .agg(F.count("*").alias("occurrences"))
        .withColumn("_forms", forms(F.col("value")))
    )
    distinct = checkpoint(distinct)
    dictionary = checkpoint(dictionary)
    tried = distinct.select("value", "occurrences", F.posexplode("_forms").alias("_rank", "form"))
    exact = (
        tried.join(_small(dictionary), "form")
        .groupBy("value")
        .agg(F.min_by("entry", "_rank").alias("entry"), F.max("occurrences").alias("occurrences"))
    )
    often = exact.groupBy("entry").agg(F.sum("occurrences").alias("_often"))
    rest = tried.join(exact, "value", "left_anti")
    length = F.length("form")
    index = checkpoint(
        dictionary.join(often, "entry", "left").select(
            "entry",
            F.col("form").alias("_meant"),
            F.coalesce("_often", F.lit(0)).alias("_often"),
            F.explode(deletes(F.col("form"))).alias("_left"),
        )
    )
    candidates = (
        rest.withColumn("_most", allowed_edits(length))
        .where("_most > 0")
        .select("value", "form", "_most", F.explode(deletes(F.col("form"), F.col("_most"))).alias("_left"))
        .join(_small(index), "_left")
        .where(F.abs(F.length("form") - F.length("_meant")) <= F.col("_most"))
        .select("value", "form", "_most", "entry", "_meant", "_often")
        .distinct()
    )
    near = (
        candidates.withColumn("_distance", _distance("form", "_meant", "_most"))
        .where(F.col("_distance").isNotNull() & ~F.isnan("_distance"))
        .groupBy("value")
        .agg(F.min(F.struct("_distance", (-F.col("_often")).alias("o"), "entry")).alias("_best"))
    )
    mapped = exact.select("value", "entry", F.lit(0.0).alias("distance")).unionByName(
        near.select("value", F.col("_best.entry").alias("entry"), F.col("_best._distance").alias("distance"))
    )
    return distinct.select("value", "occurrences").join(mapped, "value", "left").select(
        "value", "occurrences", F.coalesce("entry", F.lit(0)).alias("entry"), "distance"
    )
