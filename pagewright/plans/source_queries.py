"""Queries of sources, sinks and table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import resolution as R
from pagewright.functions import tables as T
from pagewright.functions import urls as U
from pagewright.plans import made_queries as M
from pagewright.plans.augment import read
from pagewright.plans.page_queries import ORACLE_SQL as PAGE_SQL
from pagewright.plans.page_queries import augmented
from pagewright.sources import batch_files
from pagewright.sources.charsets import charset_of, decoded


def lateral_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of made pages in SQL alone."""
    T.register(spark)
    M.made(spark, sf_dir).createOrReplaceTempView("made_pages")
    return spark.sql("SELECT p.page_id, CAST(b.ordinal AS BIGINT) AS ordinal, b.block_type, b.level, b.text FROM made_pages p, LATERAL page_blocks(p.html) b")


def partitioned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages by a table function over pages that are dealt by their host, resolved in columns."""
    T.register(spark)
    augmented(spark, sf_dir).withColumn("host", U.host(F.col("url"))).createOrReplaceTempView("host_pages")
    rows = spark.sql("SELECT * FROM page_links(TABLE(SELECT page_id, url, html, host FROM host_pages) PARTITION BY host)")
    rows = R.held(rows, "target", R.resolved(R.parts(R.effective_base(F.col("url"), F.col("base_href"))), F.col("href")))
    kind = F.concat(R.link_kind(F.col("href"), F.col("target"), U.host(F.col("url"))), F.lit("s"))
    kind = F.when(kind == "anchors", kind).otherwise(F.regexp_replace(kind, "s$", ""))
    return rows.select("page_id", kind.alias("kind"), F.lit(0).alias("position"), F.when(kind == "anchors", F.col("href")).otherwise(F.col("target")).alias("url"))


def batch_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files, read back: number and hash of each success; those without a text are errors."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints/pagewright"
    path = f"{shared.rstrip('/')}/batch-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("markdown"), F.when(F.col("text").isNull() | (F.col("doc_id") % 10 == 3), "no text").alias("error"))
    batch_files.write_documents(docs, path)
    return batch_files.read_documents(spark, path).select("n", F.md5(F.col("markdown").cast("binary")).alias("md5"))


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes of five kinds: plain, with marks, and in Latin-1 by header or by declaration."""
    html = F.regexp_replace("html", r"[^\x00-ÿ]", "?")
    declared = F.concat(F.lit('<meta charset="ISO-8859-1">'), html)
    way = F.col("page_id") % 5
    content = (
        F.when(way == 0, html.cast("binary"))
        .when(way == 1, F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), html.cast("binary")))
        .when(way == 2, F.concat(F.lit(bytearray(b"\xff\xfe")), F.encode(html, "UTF-16LE")))
        .when(way == 3, F.encode(html, "ISO-8859-1"))
        .otherwise(F.encode(declared, "ISO-8859-1"))
    )
    header = F.when(way.isin(1, 3), "text/html; charset=latin1")
    rows = read(spark, sf_dir, "pages").select("page_id", content.alias("content"), header.alias("header"))
    return rows.select("page_id", charset_of(F.col("content"), F.col("header")).alias("charset"), F.md5(decoded(F.col("content"), F.col("header")).cast("binary")).alias("md5"))


QUERIES = {f.__name__: f for f in (lateral_blocks, partitioned_links, batch_round_trip, decoded_pages)}

ORACLE_SQL = {
    "lateral_blocks": M.ORACLE_SQL["made_blocks"],
    "partitioned_links": PAGE_SQL["dom_links"],
    "batch_round_trip": "SELECT doc_id AS n, md5(text) AS md5 FROM documents WHERE text IS NOT NULL AND doc_id % 10 <> 3",
    "decoded_pages": r"""WITH t AS (SELECT page_id, page_id % 5 AS way, regexp_replace(html, '[^\x00-\x{ff}]', '?', 'g') AS html FROM pages)
        SELECT page_id, ['UTF-8', 'UTF-8', 'UTF-16LE', 'windows-1252', 'windows-1252'][way + 1] AS charset, md5(CASE WHEN way = 4 THEN '<meta charset="ISO-8859-1">' ELSE '' END || html) AS md5 FROM t""",
}
