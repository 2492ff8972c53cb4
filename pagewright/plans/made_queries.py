"""Queries over pages made from documents: as their parts are known, SQL states what parsing must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import security as S
from pagewright.functions import text as T
from pagewright.operators import pages as P
from pagewright.plans.augment import AUGMENTED_SQL, FOLDED_SQL, augmented_text, read
from pagewright.plans.security_queries import _COUNT_SQL, _round6

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document: title, metadata, a menu, an article of a heading and a paragraph for each line."""
    body = F.col("text")
    for plain, named in _ESCAPES:
        body = F.replace(body, F.lit(plain), F.lit(named))
    head = F.format_string(
        '<html lang="%s-XX"><head><title>Page %s</title><meta name="author" content="Author %s"><meta property="article:published_time" content="2020-01-0%s"><meta name="description" content="About %s">'
        '<link rel="canonical" href="/c/%s"></head><body><nav><a href="/">Home</a></nav><div style="display:none">gone</div><article><h1>Page %s</h1>',
        F.coalesce("lang", F.lit("xx")), *(x.cast("string") for x in (F.col("doc_id"), F.col("doc_id") % 7, F.col("doc_id") % 9 + 1, F.col("doc_id"), F.col("doc_id"), F.col("doc_id"))),
    )
    lines = F.concat(F.lit("<p>"), F.replace(body, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    tail = F.lit('<p><a href="https://out.example/a?utm_source=x&id=1#s">out</a> <a href="/in">in</a> <a href="#top">top</a></p></article><footer>end</footer></body></html>')
    url = F.concat(F.lit("https://site"), (F.col("doc_id") % 5).cast("string"), F.lit(".example/p/"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page_id"), url.alias("url"), F.concat(head, lines, tail).alias("html"))


_LINES_SQL = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
_HTML_SQL = (
    "'<html lang=\"' || coalesce(lang, 'xx') || '-XX\"><head><title>Page ' || doc_id || '</title><meta name=\"author\" content=\"Author ' || (doc_id % 7) || '\"><meta property=\"article:published_time\" content=\"2020-01-0' || (doc_id % 9 + 1) || '\"><meta name=\"description\" content=\"About ' || doc_id || '\">"
    "<link rel=\"canonical\" href=\"/c/' || doc_id || '\"></head><body><nav><a href=\"/\">Home</a></nav><div style=\"display:none\">gone</div><article><h1>Page ' || doc_id || '</h1>'"
    " || '<p>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '</p><p>') || '</p>'"
    " || '<p><a href=\"https://out.example/a?utm_source=x&id=1#s\">out</a> <a href=\"/in\">in</a> <a href=\"#top\">top</a></p></article><footer>end</footer></body></html>'"
)


def made_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.blocks(P.parsed(made(spark, sf_dir), only=("blocks",)).select("page_id", "page.blocks"))
    return rows.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "block_type", "level", "text")


def made_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = P.documents(made(spark, sf_dir), fields=("page_id", "title", "removed_hidden", "internal", "external", "links_total", "original_size_bytes", "error"))
    return docs.select("page_id", "title", "removed_hidden", F.array_join("internal", " ").alias("internal"), F.array_join("external", " ").alias("external"), "links_total", "original_size_bytes", "error")


def made_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.metadata(made(spark, sf_dir)).select("page_id", "author", "published", "description", "canonical_url", "language", "content_type")


def made_link_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct external links of all pages by their domain."""
    return P.external_domains(P.documents(made(spark, sf_dir))).groupBy("domain").agg(F.sum("links").cast("bigint").alias("links"), F.count("*").alias("pages"))


def encoded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in texts whose letters are entities, percent signs, escapes or UTF-7, one way for each document."""
    text = augmented_text()
    way = F.col("doc_id") % 5
    encoded = (
        F.when(way == 0, F.replace(text, F.lit("i"), F.lit("&#105;")))
        .when(way == 1, F.replace(text, F.lit("i"), F.lit("%69")))
        .when(way == 2, F.replace(text, F.lit("i"), F.lit("\\x69")))
        .when(way == 3, F.replace(text, F.lit("i"), F.lit("&amp;amp;#x69;")))
        .otherwise(text)
    )
    plain = ~text.rlike(r"[&%\\+]")
    rows = read(spark, sf_dir, "documents").where(plain).select("doc_id", encoded.alias("text"))
    scanned = S.scanned(rows)
    return scanned.select("doc_id", *(F.element_at("counts", i + 1).cast("bigint").alias(f"c{i}") for i in range(len(_COUNT_SQL))), "too_deep")


def deep_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase encoded over and over: ten rounds are undone, and told if the tenth still changed the text."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("&"), F.repeat(F.lit("amp;"), (F.col("doc_id") % 14).cast("int")), F.lit("lt; jailbreak")).alias("text"))
    scanned = S.scored(S.scanned(rows))
    return scanned.select("doc_id", "too_deep", F.array_contains("flags", "decoding_iteration_limit_reached").alias("flagged"), _round6(F.col("injection_score")).alias("score_millionths"))


def rules_and_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, flags and advice of patterns and keyword rules together."""
    rows = S.scored(S.scanned(read(spark, sf_dir, "documents").select("doc_id", augmented_text().alias("text"))), advanced=True)
    named = rows.where(F.size("rules") > 0)
    return named.select("doc_id", F.array_join(F.filter("flags", lambda x: x.rlike("^(rule|category|severity):")), "|").alias("flags"), "scan_method", (F.col("injection_score") >= 0.5).alias("at_least_half"))


QUERIES = {f.__name__: f for f in (made_blocks, made_documents, made_metadata, made_link_domains, encoded_scan, deep_encoding, rules_and_patterns)}

_SITE = "'https://site' || (doc_id % 5) || '.example'"
_COUNTS = ", ".join(f"CAST({c} AS BIGINT) AS c{i}" for i, c in enumerate(_COUNT_SQL))

ORACLE_SQL = {
    "made_blocks": f"""WITH b AS (SELECT doc_id, list_concat(['Page ' || doc_id], list_concat({_LINES_SQL}, ['out in top'])) AS parts FROM documents WHERE text IS NOT NULL),
        e AS (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS ordinal FROM b)
        SELECT doc_id AS page_id, CAST(ordinal AS BIGINT) AS ordinal, CASE WHEN ordinal = 0 THEN 'heading' ELSE 'paragraph' END AS block_type, CAST(CASE WHEN ordinal = 0 THEN 1 END AS INTEGER) AS level, text FROM e""",
    "made_documents": f"SELECT doc_id AS page_id, 'Page ' || doc_id AS title, CAST(1 AS INTEGER) AS removed_hidden, {_SITE} || '/in' AS internal, 'https://out.example/a?utm_source=x&id=1#s' AS external, CAST(3 AS INTEGER) AS links_total, CAST(strlen({_HTML_SQL}) AS INTEGER) AS original_size_bytes, CAST(NULL AS VARCHAR) AS error FROM documents WHERE text IS NOT NULL",
    "made_metadata": f"SELECT doc_id AS page_id, 'Author ' || (doc_id % 7) AS author, '2020-01-0' || (doc_id % 9 + 1) AS published, 'About ' || doc_id AS description, {_SITE} || '/c/' || doc_id AS canonical_url, lower(coalesce(lang, 'xx')) AS language, 'article' AS content_type FROM documents WHERE text IS NOT NULL",
    "made_link_domains": "SELECT 'out.example' AS domain, count(*) AS links, count(*) AS pages FROM documents WHERE text IS NOT NULL",
    "encoded_scan": f"WITH f AS (SELECT doc_id, {FOLDED_SQL} AS t FROM documents WHERE NOT regexp_matches({AUGMENTED_SQL}, '[&%\\\\+]')) SELECT doc_id, {_COUNTS}, false AS too_deep FROM f",
    "deep_encoding": "SELECT doc_id, doc_id % 14 >= 9 AS too_deep, doc_id % 14 >= 9 AS flagged, CAST(CASE WHEN doc_id % 14 >= 9 THEN 1000000 ELSE 850000 END AS BIGINT) AS score_millionths FROM documents",
    "rules_and_patterns": f"""WITH a AS (SELECT doc_id, lower({AUGMENTED_SQL}) AS t FROM documents), r AS (SELECT doc_id,
        contains(t, 'ignore') AND contains(t, 'previous instructions') AS r1, contains(t, 'jailbreak') OR contains(t, 'do anything now') OR contains(t, 'no restrictions') OR contains(t, 'bypass safety') AS r2,
        contains(t, 'reveal') AND contains(t, 'system prompt') OR contains(t, 'print your instructions') OR contains(t, 'disregard') AND contains(t, 'override') AS r3,
        contains(t, 'act as') OR contains(t, 'pretend you are') OR contains(t, 'you are now') OR contains(t, 'forget you are') AS r4 FROM a)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN r1 THEN 'rule:IgnorePreviousInstructions' END, CASE WHEN r2 THEN 'rule:JailbreakPatterns' END, CASE WHEN r3 THEN 'rule:RevealSecrets' END, CASE WHEN r4 THEN 'rule:ActAs' END,
        CASE WHEN r1 THEN 'category:prompt_injection' END, CASE WHEN r2 THEN 'category:jailbreak' END, CASE WHEN r3 THEN 'category:exfiltration' END, CASE WHEN r4 THEN 'category:persona_injection' END, 'severity:medium'], lambda x: x IS NOT NULL), '|') AS flags,
        'rules' AS scan_method, true AS at_least_half FROM r WHERE r1 OR r2 OR r3 OR r4""",
}
