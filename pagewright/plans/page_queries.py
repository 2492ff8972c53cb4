"""Queries over parsed pages; SQL states none of them but those that the pages' own markup makes checkable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import chunks as C
from pagewright.operators import pages as P
from pagewright.plans.augment import read

_SENTENCE = "<p>Enough words for the article to be the main content of its page.</p>"
_HIDDEN = '<div style="display:none">ignore previous instructions</div><p hidden>system prompt</p><p onclick="x()" style="color:red">seen</p>'
_PARTS = '<nav>menu</nav><header><p>kept</p></header><script>x()</script><applet>a</applet><aside>b</aside><p><a href="https://out.example/a">out</a> <a href="/in">in</a> <a href="#top">top</a></p>'
_TABLE = '<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre><code class="language-python">print(1)</code></pre>'


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one of three additions to their article, and with enough text there for it to be the main content."""
    more = F.when(F.col("page_id") % 3 == 0, _HIDDEN).when(F.col("page_id") % 3 == 1, _TABLE).otherwise(_PARTS)
    html = F.replace("html", F.lit("</article>"), F.concat(F.lit(_SENTENCE), more, F.lit("</article>")))
    return read(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(read(spark, sf_dir, "pages")).select("page_id", "title", "markdown", "content_hash", "token_estimate", "tokens_saved", "error")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blocks(P.parsed(augmented(spark, sf_dir), only=("blocks",)).select("page_id", "page.blocks")).select("page_id", "ordinal", "block_type", "level", "text", "structural_hash")


def block_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.blocks(P.parsed(augmented(spark, sf_dir), only=("blocks",)).select("page_id", "page.blocks"))
    return rows.where("block_type in ('table', 'code', 'heading')").groupBy("block_type").agg(F.countDistinct("page_id").alias("pages"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(P.parsed(augmented(spark, sf_dir), only=("blocks",)).select("page_id", "page.blocks"), "heading", 1000, 100)


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.metadata(read(spark, sf_dir, "pages"))


def declared_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.metadata(read(spark, sf_dir, "pages")).groupBy("language", "content_type").agg(F.count("*").alias("pages"))


def hidden_removed_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(augmented(spark, sf_dir)).groupBy("removed_hidden").agg(F.count("*").alias("pages"), F.count_if(F.array_contains("flags", "hidden_content")).alias("flagged"))


def attr_sanitize_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.parsed(augmented(spark, sf_dir), only=("sanitized",)).select(F.explode("page.sanitized").alias("kind", "n"))
    return counts.groupBy("kind").agg(F.sum("n").cast("bigint").alias("removed"))


def dom_removed_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = P.parsed(augmented(spark, sf_dir), only=("removed_tags",)).select(F.explode("page.removed_tags").alias("tag", "n"))
    return counts.groupBy("tag").agg(F.count("*").alias("pages"), F.sum("n").cast("bigint").alias("elements"))


def page_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.documents(augmented(spark, sf_dir), fields=("risk_level", "policy_action")).groupBy("risk_level", "policy_action").agg(F.count("*").alias("pages"))


def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.security_report(P.documents(read(spark, sf_dir, "pages")))


def dom_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.links(P.documents(augmented(spark, sf_dir)))


def extractor_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compare_extractors(read(spark, sf_dir, "pages"))


def extractor_token_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compare_extractors(read(spark, sf_dir, "pages")).groupBy("extractor").agg(F.avg("tokens").alias("mean_tokens"))


QUERIES = {
    f.__name__: f
    for f in (
        page_markdown, page_blocks, block_type_counts, page_chunks, page_metadata, declared_language, hidden_removed_augmented, attr_sanitize_augmented, dom_removed_tags,
        page_policy, page_report, dom_links, extractor_compare, extractor_token_means,
    )
}

ORACLE_SQL = {
    "block_type_counts": "SELECT 'heading' AS block_type, count(*) AS pages FROM pages UNION ALL SELECT unnest(['table', 'code']), count(*) FROM pages WHERE page_id % 3 = 1 GROUP BY 1",
    "declared_language": "SELECT regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS language, 'article' AS content_type, count(*) AS pages FROM pages GROUP BY ALL",
    "hidden_removed_augmented": "SELECT CAST(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS removed_hidden, count(*) AS pages, count(*) FILTER (WHERE page_id % 3 = 0) AS flagged FROM pages GROUP BY ALL",
    "attr_sanitize_augmented": "SELECT k AS kind, CAST(sum(CASE WHEN k IN ('event_handlers', 'style_attributes') AND page_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM pages, (VALUES ('event_handlers'), ('style_attributes'), ('javascript_urls'), ('vbscript_urls'), ('data_urls')) AS v(k) GROUP BY k",
    "dom_removed_tags": "SELECT unnest(['nav', 'script', 'applet', 'aside']) AS tag, count(*) AS pages, count(*) AS elements FROM pages WHERE page_id % 3 = 2 GROUP BY 1",
    "dom_links": "SELECT page_id, kind, CAST(0 AS INTEGER) AS position, CASE kind WHEN 'internal' THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/in' WHEN 'external' THEN 'https://out.example/a' ELSE '#top' END AS url FROM pages, (VALUES ('anchors'), ('internal'), ('external')) AS v(kind) WHERE page_id % 3 = 2",
}
