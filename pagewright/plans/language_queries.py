"""Queries of detected languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import languages as L
from pagewright.plans.augment import read


def _held_out() -> F.Column:
    return F.md5(F.col("doc_id").cast("string").cast("binary")) < "4"


def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by profiles of those that aren't held out (the checksum of the id decides)."""
    docs = read(spark, sf_dir, "documents")
    return L.detected(docs, L.profiles(docs.where(~_held_out()))).select("doc_id", "detected", "distance")


def language_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, held out and not, are detected to be in each language, by the one that they have."""
    docs = read(spark, sf_dir, "documents")
    found = L.detected(docs, L.profiles(docs.where(~_held_out()))).select("doc_id", "detected")
    rows = docs.select("doc_id", "lang", _held_out().alias("held_out")).join(found, "doc_id")
    return rows.groupBy("held_out", "lang", "detected").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (detected_language, language_agreement)}

_FOUND = rf"""WITH t AS (SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR)) < '4' AS held_out, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
    g AS (SELECT doc_id, lang, held_out, substring(t, CAST(unnest(range(1, length(t) - 1)) AS BIGINT), 3) AS gram FROM t WHERE length(t) > 2),
    p AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) - 1 AS place FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, gram QUALIFY place < {L.TOP}),
    o AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) - 1 AS place FROM g GROUP BY doc_id, gram QUALIFY place < {L.TOP}),
    s AS (SELECT doc_id, n.lang, sum(CASE WHEN p.place IS NULL THEN {L.TOP} ELSE abs(p.place - o.place) END) AS distance FROM o CROSS JOIN (SELECT DISTINCT lang FROM p) n LEFT JOIN p ON p.lang = n.lang AND p.gram = o.gram GROUP BY doc_id, n.lang),
    d AS (SELECT doc_id, lang AS detected, CAST(distance AS BIGINT) AS distance FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) = 1)"""

ORACLE_SQL = {
    "detected_language": _FOUND + " SELECT doc_id, detected, distance FROM t LEFT JOIN d USING (doc_id)",
    "language_agreement": _FOUND + " SELECT held_out, lang, detected, count(*) AS documents FROM t LEFT JOIN d USING (doc_id) GROUP BY ALL",
}
