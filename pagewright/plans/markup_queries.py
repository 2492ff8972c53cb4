"""Queries over pages of known markup: Markdown of nested blocks, main content of layouts, styles, policies as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import api
from pagewright.functions import dom as D
from pagewright.functions import resolution as R
from pagewright.functions import styles
from pagewright.functions import urls as U
from pagewright.operators import pages as P
from pagewright.plans.augment import read
from pagewright.plans.page_queries import augmented
from pagewright.plans.url_queries import HOST_SQL


def _lines() -> F.Column:
    """Lines of a text that aren't blank, their blanks single."""
    return F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _escaped(text: F.Column) -> F.Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_LINES_SQL = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"


def made_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page whose lines stand in paragraphs, nested quotes, nested lists, code and tables, in turn."""

    def part(line: F.Column, i: F.Column) -> F.Column:
        n, kind = i.cast("string"), i % 5
        shapes = [
            ("<p>", "</p>"),
            ("<blockquote><blockquote><p>", "</p></blockquote>out <b>#</b></blockquote>"),
            ("<ul><li>", "<div><ol><li>#</li><li>n</li></ol></div>end</li><li><p>x</p><p>y</p></li></ul>"),
            ('<pre><code class="language-sql">', "\n#</code></pre>"),
            ("<table><tr><th>h</th><th>", "</th></tr><tr><td>#</td></tr></table>"),
        ]
        out = None
        for k, (before, after) in enumerate(shapes):
            made = F.concat(F.lit(before), line, F.replace(F.lit(after), F.lit("#"), n))
            out = F.when(kind == k, made) if out is None else out.when(kind == k, made)
        return out

    parts = F.array_join(F.transform(_lines(), lambda x, i: part(_escaped(x), i)), "")
    html = F.concat(F.lit("<html><body><nav>menu</nav><article><h1>Page</h1>"), parts, F.lit("</article></body></html>"))
    pages = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page_id"), F.lit("https://a.org/").alias("url"), html.alias("html"))
    rows = P.blocks(P.parsed(pages, only=("blocks",)).select("page_id", "page.blocks"))
    return rows.select("page_id", F.col("ordinal").cast("bigint").alias("ordinal"), "block_type", "markdown")


#: Layouts in which a text is put, and whether its article is all that stays.
_SENTENCE = "This sentence, long enough to be scored, belongs to the article of its page."
_MENU = "<ul>" + "".join(f'<li><a href="/m{i}">Menu entry number {i} with some words</a></li>' for i in range(12)) + "</ul>"
_COMMENT = "<p>A reader, who has much to say, wrote this comment, and it goes on for a while, as comments do.</p>"
LAYOUTS = [
    "<article>@@</article>",
    "<div><div class='part'>@</div><div class='part'>@</div></div>",
    f"<div class='menu'>{_MENU}</div><div>@@</div>",
    f"<div id='content'>@@</div><div class='comments'>{_COMMENT * 3}</div>",
    f"<table><tr><td>{_MENU}</td><td>@@</td></tr></table>",
    f"<main><section><h2>First</h2>@</section><section><h2>Second</h2>@</section></main><div class='sidebar'><p>{_SENTENCE.replace('article', 'sidebar')}</p></div>",
    f"<div><div><div>@</div><div>@</div></div></div><div class='related'>{_MENU}{_COMMENT}</div>",
]


def main_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put into layouts, half of the lines in each half: how many characters of text stay, and what else does.

    Of a line only its place and length count in the layout; a sentence before each half makes it long enough.
    """
    lines = F.col("lines")
    half = F.ceil(F.size(lines) / 2).cast("int")

    def paragraphs(some: F.Column) -> F.Column:
        return F.concat(F.lit(f"<p>{_SENTENCE}</p><p>{_SENTENCE}</p>"), F.array_join(F.transform(some, lambda x: F.concat(F.lit("<p>"), _escaped(x), F.lit("</p>"))), ""))

    first, second = paragraphs(F.slice(lines, 1, half)), paragraphs(F.slice(lines, half + 1, F.size(lines)))
    layout = F.split(F.element_at(F.array(*map(F.lit, LAYOUTS)), (F.col("doc_id") % len(LAYOUTS) + 1).cast("int")), "@")
    html = F.concat(F.lit("<html><body>"), layout[0], first, layout[1], second, layout[2], F.lit("</body></html>"))
    docs = R.held(read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "lines", _lines())
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a.org/").alias("url"), html.alias("html"))
    text = F.regexp_replace("page.text", r"\s", "")
    return P.parsed(pages, only=("text",)).select(
        "page_id", F.length(text).cast("bigint").alias("chars"), F.contains("page.text", F.lit("Menu entry")).alias("has_menu"), F.contains("page.text", F.lit("wrote this comment")).alias("has_comments"), F.contains("page.text", F.lit("to the sidebar")).alias("has_sidebar")
    )


#: Styles and whether they hide.
STYLES = [
    ("transform:translateX(-9999px)", True), ("width:calc(0px)", True), ("color:rgba(0,0,0,0)", True), ("color:rgb(0 0 0 / 0%)", True), ("color:rgba(0,0,0,.5)", False), ("opacity:0", True), ("opacity: 0.5", False), ("width:0 !important", True),
    ("width:10px", False), ("left:-9999px", True), ("left:-10px", False), ("text-indent:-70em", True), ("dis/**/play:none", True), ("background:url('a;display:none')", False), ("width:calc(1px - 1px)", True), ("width:calc(100% - 10px)", False),
    ("clip:rect(0,0,0,0)", True), ("clip:rect(0px, 100px, 50px, 0px)", False), ("clip-path:inset(50%)", True), ("clip-path:inset(10%)", False), ("transform:scale(0)", True), ("transform:scale(1.1)", False), ("transform: rotate(3deg) scaleX(0)", True),
    ("color:#0000", True), ("color:#000", False), ("filter:opacity(0)", True), ("\\64isplay:none", True), ("content:'x", False), ("visibility : Collapse", True), ("font-size:1e-0px", False), ("display:block;display:none", True), ("color:transparent", True),
]


def style_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, of which each stands in an element with one of the styles: whether its text stays."""
    style = F.element_at(F.array(*(F.lit(s) for s, _ in STYLES)), (F.col("doc_id") % len(STYLES) + 1).cast("int"))
    body = F.concat(F.lit("<html><body><article><p>"), F.lit(_SENTENCE), F.lit('</p><div style="'), F.replace(style, F.lit('"'), F.lit("&quot;")), F.lit('"><p>'), _escaped(F.col("text")), F.lit("</p></div></article></body></html>"))
    pages = read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("page_id"), F.lit("https://a.org/").alias("url"), body.alias("html"))
    return P.parsed(pages, only=("removed_hidden",)).select("page_id", "page.removed_hidden")


def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy for each host of the pages and each customer, and one for a domain with all below it, of the last priority."""
    hosts = read(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("domain")).distinct()
    n = F.length("domain")
    own = hosts.where(n % 3 > 0).select(F.lit(1).alias("priority"), "domain", F.lit(False).alias("include_subdomains"), n.alias("n"))
    others = read(spark, sf_dir, "customer").select(F.lit(0).alias("priority"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".example.com")).alias("domain"), F.lit(True).alias("include_subdomains"), F.lit(7).alias("n"))
    last = spark.createDataFrame([(2, "example.net", True, 10)], "priority int, domain string, include_subdomains boolean, n int")
    every = own.unionByName(others).unionByName(last)
    n = F.col("n")
    return every.select(
        "priority", "domain", "include_subdomains", F.when(n % 4 == 0, "permissive").when(n % 4 == 1, "normal").alias("policy_name"), F.when(n % 5 == 0, F.lit(0.0)).alias("block_threshold"),
        F.when(n % 2 == 0, F.array(F.lit("table"))).alias("blocked_tags"), F.when(n % 7 == 0, F.array(F.lit("pre"))).alias("blocked_selectors"), F.concat(F.lit("n"), n.cast("string")).alias("notes"),
    )


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with tables and code under more than a thousand policies: what their policy took, and whether it blocks."""
    docs = api.ingest_by_domain(augmented(spark, sf_dir), policy_table(spark, sf_dir))
    kinds = F.transform("blocks", lambda b: b["block_type"])
    return docs.select(
        "page_id", "domain", "notes", F.array_contains(kinds, "table").alias("has_table"), F.array_contains(kinds, "code").alias("has_code"), (F.col("policy_action") == "block").alias("blocked"), (F.col("rules_changed") > 0).alias("changed")
    )


def configured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON under a profile with a rule file and weights of a user's own: what of it is there."""
    rules = 'rule Menu { meta: severity = "high" category = "own" keywords: $a = "enough words" $b = "nowhere" condition: $a and not_used or $b }'
    config = api.Config.of({"output_profile": "rag_chunkable", "rule_text": rules, "advanced_security": True, "pattern_weights": ((r"\bword5\b", 0.5),), "output_formats": ("metadata", "chunks")})
    rows = api.serialised(api.ingest(augmented(spark, sf_dir), config), config)
    said = {"formats": "$.emitted_formats", "author": "$.metadata.author", "language": "$.metadata.language", "mode": "$.mode", "chunk": "$.chunks[0].chunk_id", "table": "$.blocks[*].block_type"}
    got = rows.select("page_id", *(F.get_json_object("document_json", path).alias(name) for name, path in said.items()))
    return got.select("page_id", "formats", "language", "mode", "chunk", F.contains("table", F.lit('"table"')).alias("has_table"))


QUERIES = {f.__name__: f for f in (configured_documents, made_markdown, main_contents, style_values, policy_documents)}

_KEPT = "length(regexp_replace(text, '\\s', '', 'g'))"
_SIZE = len(_SENTENCE.replace(" ", ""))
_HIDDEN = ", ".join("1" if hidden else "0" for _, hidden in STYLES)

ORACLE_SQL = {
    "configured_documents": """SELECT page_id, '["metadata","chunks","markdown","blocks","security"]' AS formats, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, 'auto' AS mode, 'chunk-1' AS chunk, page_id % 3 = 1 AS has_table FROM pages""",
    "made_markdown": rf"""WITH l AS (SELECT doc_id, {_LINES_SQL} AS lines FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(lines) AS x, generate_subscripts(lines, 1) - 1 AS i FROM l)
        SELECT doc_id AS page_id, CAST(0 AS BIGINT) AS ordinal, 'heading' AS block_type, '# Page' AS markdown FROM l UNION ALL
        SELECT doc_id, CAST(i + 1 AS BIGINT), ['paragraph', 'quote', 'list', 'code', 'table'][i % 5 + 1], replace(CASE i % 5 WHEN 0 THEN x WHEN 1 THEN '> > ' || x || '~>~> out **' || i || '**'
            WHEN 2 THEN '- ' || x || '~  1. ' || i || '~  2. n~  end~- x y' WHEN 3 THEN '```sql~' || x || '~' || i || '~```'
            ELSE '| h | ' || replace(replace(x, '\', '\\'), '|', '\|') || ' |~| --- | --- |~| ' || i || ' |  |' END, '~', chr(10)) FROM e""",
    "main_contents": f"""WITH t AS (SELECT doc_id, doc_id % {len(LAYOUTS)} AS layout, {_KEPT} AS n FROM documents WHERE text IS NOT NULL)
        SELECT doc_id AS page_id, CAST(n + 4 * {_SIZE} + CASE WHEN layout = 5 THEN {len('FirstSecond')} ELSE 0 END AS BIGINT) AS chars, false AS has_menu, false AS has_comments, false AS has_sidebar FROM t""",
    "style_values": f"SELECT doc_id AS page_id, CAST([{_HIDDEN}][doc_id % {len(STYLES)} + 1] AS INTEGER) AS removed_hidden FROM documents WHERE text IS NOT NULL",
    "policy_documents": f"""WITH h AS (SELECT page_id, page_id % 3 = 1 AS tables, {HOST_SQL} AS host, length({HOST_SQL}) AS len FROM pages),
        p AS (SELECT page_id, tables, CASE WHEN len % 3 > 0 THEN host WHEN ends_with(host, '.example.net') THEN 'example.net' END AS domain, CASE WHEN len % 3 > 0 THEN len WHEN ends_with(host, '.example.net') THEN 10 END AS n FROM h)
        SELECT page_id, domain, 'n' || n AS notes, tables AND coalesce(n % 2, 1) <> 0 AS has_table, tables AND coalesce(n % 7, 1) <> 0 AS has_code, coalesce(n % 5, 1) = 0 AS blocked,
            tables AND (coalesce(n % 2, 1) = 0 OR coalesce(n % 7, 1) = 0) AS changed FROM p""",
}
