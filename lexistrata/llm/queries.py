"""The queries of this subpackage and, where SQL can express them, their equivalents for an SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexistrata.engine import checkpoint, table
from lexistrata.functions.cleaning import clean
from lexistrata.llm import set_join, value_mapping
from lexistrata.llm.leakage import leaked_items
from lexistrata.llm.name_variants import resolve_names, variant_pairs
from lexistrata.llm.term_frequency import term_frequency
from lexistrata.llm.tokenize import encode_corpus
from lexistrata.llm.truncation import score_texts

SPACE_SQL = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def all_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the three typed fields with their occurrences, records and marks."""
    sample, catalog = table(spark, sf_dir, "sample_records"), table(spark, sf_dir, "catalog_records")
    of_sample = term_frequency(
        sample,
        {"tags.name": F.col("tags.name"), "resources.format": F.col("resources.format")},
        F.col("id"),
        F.col("row_id"),
    )
    of_catalog = term_frequency(catalog, {"dcat.keyword": F.col("dcat.keyword")}, F.col("id"), F.col("row_id"))
    return of_sample.unionByName(of_catalog)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms too rare or too common to describe a dataset."""
    return all_frequencies(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term."""
    return all_frequencies(spark, sf_dir).select("field", "term", "occurrences", "records")


_P1_SQL = rf"""
WITH items AS (
  SELECT 'tags.name' AS field, coalesce('i' || id, 'r' || row_id) AS rec, 's' AS src, t.name AS raw
    FROM (SELECT id, row_id, unnest(tags) AS t FROM sample_records)
  UNION ALL SELECT 'resources.format', coalesce('i' || id, 'r' || row_id), 's', t.format
    FROM (SELECT id, row_id, unnest(resources) AS t FROM sample_records)
  UNION ALL SELECT 'dcat.keyword', coalesce('i' || id, 'r' || row_id), 'c', t
    FROM (SELECT id, row_id, unnest(dcat.keyword) AS t FROM catalog_records)
), totals AS (
  SELECT 's' AS src, count(DISTINCT coalesce('i' || id, 'r' || row_id)) AS n FROM sample_records
  UNION ALL SELECT 'c', count(DISTINCT coalesce('i' || id, 'r' || row_id)) FROM catalog_records
), terms AS (
  SELECT field, src, lower(trim(regexp_replace(raw, '{SPACE_SQL}', ' ', 'g'))) AS term, rec FROM items WHERE raw IS NOT NULL
), counted AS (
  SELECT field, src, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM terms WHERE term <> '' GROUP BY ALL
)
"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample, catalog = table(spark, sf_dir, "sample_records"), table(spark, sf_dir, "catalog_records")
    typed = sample.select(F.col("organization.title").alias("name")).unionByName(
        catalog.select(F.col("dcat.publisher.name").alias("name"))
    )
    return resolve_names(typed, "name")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spellings that name the same body or person."""
    return variant_pairs(_entities(spark, sf_dir), "name")


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the number of spellings of its entity."""
    members = _entities(spark, sf_dir)
    sizes = members.groupBy("entity").agg(F.count("*").alias("spellings"))
    return members.join(sizes, "entity")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of the format list meant by every distinct format or media type, 0 if none."""
    sample, listed = table(spark, sf_dir, "sample_records"), table(spark, sf_dir, "format_list")
    typed = sample.select(F.explode("resources").alias("r")).select(F.array("r.format", "r.mimetype", "r.mediaType").alias("t"))
    dictionary = checkpoint(value_mapping.reference_forms(listed, "format_id", ["label", "media_type", "extension"], None))
    # What stands beside a name in the same resource teaches what it means.
    pairs = F.array(*(F.struct(F.col("t")[i].alias("value"), F.col("t")[j].alias("other")) for i in range(3) for j in range(3) if i != j))
    learned = value_mapping.learned_forms(typed.select(F.inline(pairs)), dictionary)
    mapped = value_mapping.map_values(typed.select(F.explode("t").alias("value")), "value", dictionary.unionByName(learned))
    return mapped.select("value", F.col("entry").alias("format_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the two record tables whose tags, keywords and themes largely agree."""
    sample, catalog = table(spark, sf_dir, "sample_records"), table(spark, sf_dir, "catalog_records")
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce("dcat.keyword", none), F.coalesce("dcat.theme", none))
    rows = sample.select("row_id", "id", F.col("tags.name").alias("items")).unionByName(
        catalog.select("row_id", "id", words.alias("items"))
    )
    cleaned = rows.withColumn("items", F.transform("items", clean))
    return set_join.similar_sets(cleaned, "row_id", "items", group="id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation items that they give away."""
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")
    return leaked_items(documents, "doc_id", "text", items, "item_id", "passage").select("doc_id", "item_id").distinct()


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut off."""
    return _ends(spark, sf_dir).where("cut").select("doc_id").distinct()


def p10_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts off."""
    return (
        _ends(spark, sf_dir)
        .groupBy("source")
        .agg(F.count("*").alias("texts"), F.count_if("cut").alias("cut"))
        .withColumn("rate", F.col("cut") / F.col("texts"))
    )


_P7_SQL = rf"""
WITH items AS (
  SELECT row_id, id, unnest(tags).name AS v FROM sample_records
  UNION ALL SELECT row_id, id, unnest(list_concat(dcat.keyword, dcat.theme)) FROM catalog_records
), vals AS (
  SELECT DISTINCT row_id, id, lower(trim(regexp_replace(v, '{SPACE_SQL}', ' ', 'g'))) AS v FROM items WHERE v IS NOT NULL
), sized AS (
  SELECT row_id, id, v, count(*) OVER (PARTITION BY row_id) AS n FROM vals WHERE v <> ''
)
SELECT row_a, row_b FROM (
  SELECT a.row_id AS row_a, b.row_id AS row_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM sized a JOIN sized b ON a.v = b.v AND a.row_id < b.row_id AND a.id <> b.id AND a.n >= 3 AND b.n >= 3
    AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n
  GROUP BY a.row_id, b.row_id)
WHERE 10 * shared >= 6 * (na + nb - shared)
"""


def queries() -> dict:
    """Callables by query name."""
    return {
        "p1_found": p1_found,
        "p1_term_frequency": p1_term_frequency,
        "p2_found": p2_found,
        "p2_entities": p2_entities,
        "p4_found": p4_found,
        "p7_found": p7_found,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p10_found": p10_found,
        "p10_source_rates": p10_source_rates,
    }


def oracle_sql() -> dict[str, str]:
    """Equivalent SQL by query name."""
    return {
        "p1_found": _P1_SQL
        + """SELECT field, term, CASE WHEN records <= 2 THEN 'rare' ELSE 'common' END AS mark
FROM counted JOIN totals USING (src) WHERE records <= 2 OR records * 10 > n""",
        "p7_found": _P7_SQL,
        "p1_term_frequency": _P1_SQL + "SELECT field, term, occurrences, records FROM counted",
    }
