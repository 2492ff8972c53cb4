"""Pages to documents: one parse of each page on the executors, everything else as columns and explodes.

Defined results: a null or blank html gives a row in which ``error`` says so and the content is null; a page that can't
be parsed does as well. No page is dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from pagewright.functions import dom as D
from pagewright.functions import fixed as V
from pagewright.functions import resolution as R
from pagewright.functions import security as S
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.functions.fixed import ZERO_WIDTH
from pagewright.functions.slices import sliced, small_batches

BLOCK = "struct<block_type:string,level:int,text:string,markdown:string,structural_hash:string,metadata:struct<tag:string,rows:int,columns:int,language:string>>"
PAGE = (
    f"title string, text string, markdown string, structural_hash string, blocks array<{BLOCK}>, removed_tags map<string,int>, removed_hidden int, "
    "sanitized map<string,int>, rules_changed int, hrefs array<string>, base_href string, error string"
)
METADATA = (
    "author string, published string, modified string, description string, keywords string, site_name string, canonical array<string>, base_href string, language string, content_type string, error string"
)
RULES = "blocked_selectors array<string>, unwrap_selectors array<string>, blocked_tags array<string>, allowed_tags array<string>"

# Meta names by field, in order of preference, and what tells the kind of a page.
_META = {
    "author": ("author", "article:author"),
    "published": ("article:published_time", "datePublished", "publishdate"),
    "modified": ("article:modified_time", "dateModified", "last-modified"),
    "description": ("description", "og:description", "twitter:description"),
    "site_name": ("og:site_name", "application-name"),
}
_KINDS = [
    ("article", "article .post .article"),
    ("documentation", ".documentation #docs .docs .api-doc .api-docs .api-documentation"),
    ("forum", ".forum .discussion .thread .comment .comments .comment-list .comment-thread"),
    ("ecommerce", ".product [itemtype*=Product] .price .add-to-cart"),
]


# What a parse must work out for a column of ``documents``, where that is not the field of the same name.
_LINKS, _MARKDOWN, _SCANNED = ("hrefs", "base_href"), ("markdown",), ("text", "removed_hidden")
_NEEDS = (
    dict.fromkeys(("anchors", "internal", "external", "links_total"), _LINKS)
    | dict.fromkeys(("content_hash", "token_estimate", "tokens_saved", "cleaned_size_bytes"), _MARKDOWN)
    | dict.fromkeys(("injection_score", "basic_score", "rule_score", "scan_method", "risk_level", "flags", "policy_action", "explanation", "imperative_density"), _SCANNED)
    | {"hidden_content_detected": ("removed_hidden",)}
)

_INVISIBLE = re.compile(f"[{re.escape(ZERO_WIDTH)}]")


def _sliced(kind: pa.StructType, row: Callable[..., dict], *columns: pa.Array) -> Iterator[pa.Array]:
    """``row`` of each row of the columns, as structs: see ``functions.slices``. Arrow takes maps as lists of pairs."""
    maps = [f.name for f in kind if pa.types.is_map(f.type)]

    def made(*values: object) -> dict:
        found = row(*values)
        return found | {m: list(found[m].items()) for m in maps if found.get(m) is not None}

    return sliced(kind, made, *columns)


def clean_markdown(markdown: str) -> str:
    """NFC without invisible characters; single blanks outside code, a space after heading marks, one line end at the end."""
    out = T.normal_lines(markdown if markdown.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFC", markdown)))
    out = re.sub(r"(?m)^(#{1,6})([^#\s])", r"\1 \2", re.sub(r"(?m)[ \t]+$", "", out))
    return re.sub(r"\n{3,}", "\n\n", out).strip(" ") + "\n"


def _page(html: str | None, rules: dict, only: tuple[str, ...] = ()) -> dict:
    """What a page has of ``PAGE``; with ``only``, these fields and what comes on the way to them."""
    def wanted(*names: str) -> bool:
        return not only or not set(only).isdisjoint(names)

    if not (html or "").strip():
        return {"error": "empty html"}
    try:
        root = D.parse(html)
        title = root.find("title")
        out = {"title": title.text() if title else None, "base_href": D.base_href(root), "removed_hidden": D.remove_hidden(root)}
        content = D.main_content(root)
        removed = D.remove_tags(content, D.UNWANTED)
        out["rules_changed"] = D.apply_rules(content, **rules)
        out |= {"removed_tags": removed, "sanitized": D.sanitize(content)}
        if wanted("text"):
            out["text"] = content.text()
        if wanted("blocks", "markdown", "structural_hash"):
            parts = D.content(content)
            out["blocks"] = [x for x in parts if isinstance(x, dict)]
        if wanted("markdown", "structural_hash"):
            out["markdown"] = clean_markdown("\n\n".join(x if isinstance(x, str) else x["markdown"] for x in parts))
            out["structural_hash"] = hashlib.sha256(D.structure(out["markdown"]).encode()).hexdigest()
        if wanted("hrefs"):
            out["hrefs"] = D.hrefs(content)
        return out
    except (RecursionError, ValueError, AssertionError) as e:
        return {"error": f"{type(e).__name__}: {e}"}


def _rules(given: dict | None) -> dict:
    """A page's rules as lists; a null struct or field has none."""
    return {k: [y for y in (given or {}).get(k) or [] if y] for k in (f.split(" ")[0] for f in RULES.split(", "))}


def parsed(pages: DataFrame, rules: Column | None = None, only: tuple[str, ...] = (), made: tuple[str, ...] = (), **same) -> DataFrame:
    """The input with a column ``page``: one parse of each page.

    ``rules``: a struct column of ``RULES``, each page's own (null: none); or blocked_selectors, unwrap_selectors,
    blocked_tags and allowed_tags as values for all pages. ``only``: fields of ``PAGE`` that ``page`` has and that are
    worked out; without it, it has all, and lists of resolved links. ``made``: of these all, what is worked out for
    certain; others may be null.
    """
    small_batches(pages.sparkSession)
    if rules is None:
        rules = F.struct(*((F.array(*map(F.lit, same.get(f.split(" ")[0], ()))).cast("array<string>")).alias(f.split(" ")[0]) for f in RULES.split(", ")))
    schema = StructType.fromDDL(PAGE)
    schema = StructType([schema[name] for name in only]) if only else schema
    kind = to_arrow_type(schema)

    @F.arrow_udf(schema)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, own in batches:
            yield from _sliced(kind, lambda h, r: _page(h, _rules(r), only or made), html, own)

    out = R.held(pages, "page", run("html", rules))  # else Spark parses again for a filter of what is exploded
    if only:
        return out
    url = F.coalesce("url", F.lit(""))
    out = R.held(out, "__base", R.effective_base(url, F.col("page.base_href")))
    out = R.held(out, "__links", R.link_lists(F.col("page.hrefs"), F.col("__base"), url))
    page = F.col("page")
    for name in ("anchors", "internal", "external"):
        page = page.withField(name, F.col(f"__links.{name}"))
    return out.withColumn("page", page.dropFields("hrefs", "base_href")).drop("__base", "__links")


def documents(
    pages: DataFrame, block_threshold: Column | float = 0.7, warn_threshold: Column | float = 0.4, advanced: bool = False, custom: list[tuple[str, float, str]] = (), rules: Column | None = None, keep: tuple[str, ...] = (), fields: tuple[str, ...] = (),
    patterns: list[tuple[str, float, str]] = V.INJECTION_PATTERNS, keyword_rules: list[tuple] = V.KEYWORD_RULES, **same,
) -> DataFrame:
    """page_id, url, title, Markdown, hashes, sizes, tokens, links, score, flags, risk and policy action of each page.

    Thresholds may be columns, each page's own; ``rules`` and the names in ``same`` are those of ``parsed``; ``keep``:
    further columns of ``pages`` that the result has; ``fields``: the columns that are wanted of it (none: all), so that
    a parse works out no others. ``advanced`` lets keyword rules count; ``custom``: a user's
    patterns, from ``guards.custom_patterns``; ``patterns`` and ``keyword_rules``: others instead of the fixed ones.
    """
    limits = {"__block": block_threshold, "__warn": warn_threshold}
    given = pages.withColumns({k: x if isinstance(x, Column) else F.lit(float(x)) for k, x in limits.items()})
    block, warn = F.col("__block"), F.col("__warn")
    made = tuple(sorted({x for f in fields for x in _NEEDS.get(f, (f,))}))
    rows = parsed(given, rules, made=made, **same).select("page_id", "url", "html", *keep, *limits, "page.*")
    hidden = F.coalesce(F.col("removed_hidden"), F.lit(0)) > 0
    scanned = S.scanned(rows, patterns=[*patterns, *custom], rules=keyword_rules)
    rows = S.scored(scanned, hidden, advanced, patterns, block=block, warn=warn, custom=list(custom), rules=keyword_rules)
    changed = F.coalesce(F.col("rules_changed"), F.lit(0)) > 0
    rows = rows.withColumn("flags", F.array_compact(F.concat("flags", F.array(F.when(changed, F.lit("domain_rules_applied"))))))
    action = S.action(F.col("injection_score"), block, warn)
    html_tokens, tokens = T.tokens_about(F.col("html")), T.tokens_about(F.col("markdown"))
    out = rows.select(
        *keep, "page_id", "url", "title", "markdown", "blocks", "removed_tags", "removed_hidden", "sanitized", "anchors", "internal", "external", "error",
        T.content_hash(F.col("markdown")).alias("content_hash"), html_tokens.alias("html_tokens"), tokens.alias("token_estimate"),
        F.greatest(F.lit(0), html_tokens - tokens).alias("tokens_saved"), "injection_score", "basic_score", "rule_score", "scan_method", S.risk_level(F.col("injection_score")).alias("risk_level"),
        F.when(action == "block", F.array_union("flags", F.array(F.lit("policy_block")))).otherwise(F.col("flags")).alias("flags"), action.alias("policy_action"), "explanation",
        F.octet_length("html").alias("original_size_bytes"), F.octet_length("markdown").alias("cleaned_size_bytes"), F.round("density", 3).alias("imperative_density"), hidden.alias("hidden_content_detected"),
        "structural_hash", (F.size("anchors") + F.size("internal") + F.size("external")).alias("links_total"), F.coalesce("rules_changed", F.lit(0)).alias("rules_changed"),
    )
    return out.select(*keep, *fields) if fields else out


def external_domains(docs: DataFrame) -> DataFrame:
    """page_id, domain, links: a page's distinct external links by domain."""
    rows = docs.select("page_id", F.explode("external").alias("target"))
    return rows.groupBy("page_id", U.host(F.col("target")).alias("domain")).agg(F.count("*").alias("links"))


def blocks(docs: DataFrame) -> DataFrame:
    return docs.select("page_id", F.posexplode("blocks").alias("ordinal", "b")).select("page_id", "ordinal", "b.*")


def links(docs: DataFrame) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("urls")) for k in ("anchors", "internal", "external")])
    return docs.select("page_id", F.explode(kinds).alias("x")).select("page_id", "x.kind", F.posexplode_outer("x.urls").alias("position", "url")).where("url is not null")


def _json_ld(root: D.Node) -> list[dict]:
    """Objects of a page's linked data, to a bounded number; a script that isn't JSON, or is nested too deep, has none."""
    out: list[dict] = []
    for node in root.nodes():
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                waiting = [json.loads("".join(c for c in node.children if isinstance(c, str)))]
            except (ValueError, RecursionError):
                continue
            while waiting and len(out) < 10_000:
                item = waiting.pop()
                if isinstance(item, list):
                    waiting += item
                elif isinstance(item, dict):
                    out.append(item)
                    waiting += [item["@graph"]] if "@graph" in item else []
    return out


def _said(value: object) -> str | None:
    """Text of what linked data has for a field: a text, a number, an object's name, or the first of a list that has one."""
    waiting = [value]
    while waiting:
        item = waiting.pop()
        if isinstance(item, list):
            waiting += reversed(item)
        elif isinstance(item, dict):
            waiting.append(item.get("name"))
        elif isinstance(item, (str, int, float)) and not isinstance(item, bool) and str(item).strip():
            return str(item).strip()
    return None


def _metadata(html: str | None) -> dict:
    try:
        return _declared(D.parse(html or ""))
    except (RecursionError, ValueError, AssertionError) as e:
        return {"error": f"{type(e).__name__}: {e}"}


def _declared(root: D.Node) -> dict:
    nodes = list(root.nodes())
    meta: dict[str, list[str]] = {}
    for node in nodes:
        name = node.attrs.get("name") or node.attrs.get("property") or node.attrs.get("http-equiv")
        if node.tag == "meta" and name and node.attrs.get("content", "").strip():
            meta.setdefault(name, []).append(node.attrs["content"].strip())
    out = {field: next((meta[n][0] for n in names if n in meta), None) for field, names in _META.items()}
    linked = _json_ld(root)
    for field, key in (("author", "author"), ("published", "datePublished"), ("modified", "dateModified")):
        out[field] = out[field] or next((text for x in linked if (text := _said(x.get(key)))), None)
    out["keywords"] = next(iter(meta.get("keywords", [])), None) or ", ".join(meta.get("article:tag", [])) or None
    out["base_href"] = D.base_href(root)
    out["canonical"] = [n.attrs["href"] for n in nodes if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href", "").strip()]
    out["canonical"] += meta.get("og:url", [])
    html_node = root.find("html")
    declared = (html_node.attrs.get("lang", "") if html_node else "") or next(iter(meta.get("content-language", [])), "")
    out["language"] = declared.lower().split(",")[0].split("-")[0].strip() or None
    is_article = "article" in meta.get("og:type", [])
    out["content_type"] = "article" if is_article else next((k for k, selectors in _KINDS if any(D.matches(n, s) for s in selectors.split() for n in nodes)), "webpage")
    return out


def metadata(pages: DataFrame) -> DataFrame:
    """page_id and ``with_metadata``'s fields."""
    return with_metadata(pages.select("page_id", "url", "html")).select("page_id", "metadata.*")


def with_metadata(pages: DataFrame) -> DataFrame:
    """The input with a column ``metadata``: meta elements, linked data, canonical address, language, kind of a page.

    The canonical address is the first that a link or og:url gives which resolves to a web address, or else the page's
    own. A page that can't be read has a row with ``error``, null otherwise, and its own address.
    """
    names = [f.split(" ")[0] for f in METADATA.split(", ")]

    kind = to_arrow_type(StructType.fromDDL(METADATA))

    @F.arrow_udf(METADATA)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            yield from _sliced(kind, _metadata, html)

    rows = R.held(pages, "__said", run("html"))
    base = R.parts(R.effective_base(F.coalesce("url", F.lit("")), F.col("__said.base_href")))
    urls = R.let(base, lambda b: F.transform("__said.canonical", lambda x: R.resolved(b, x)))
    found = F.coalesce(F.get(F.filter(urls, R.is_web), F.lit(0)), F.col("url"))
    fields = [found.alias("canonical_url") if n == "canonical" else F.col(f"__said.{n}").alias(n) for n in names if n != "base_href"]
    return R.held(rows, "metadata", F.struct(*fields)).drop("__said")


def security_report(docs: DataFrame) -> DataFrame:
    """A projection of documents, and the same as JSON."""
    fields = """page_id url title injection_score risk_level flags policy_action content_hash structural_hash html_tokens token_estimate tokens_saved hidden_content_detected
        removed_hidden removed_tags imperative_density original_size_bytes cleaned_size_bytes explanation""".split()
    return docs.select(*fields, F.to_json(F.struct(*fields)).alias("report_json"))


def compare_extractors(pages: DataFrame) -> DataFrame:
    """Main content against the whole body, a row each: lengths, tokens, headings, links, fences, tables."""
    main = parsed(pages, only=("markdown",)).select("page_id", F.lit("main").alias("extractor"), "page.markdown")
    body = pages.select("page_id", F.lit("body").alias("extractor"), F.trim(F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")).alias("markdown"))
    md = F.col("markdown")
    return main.unionByName(body).select(
        "page_id", "extractor", F.length(md).alias("length"), T.tokens_about(md).alias("tokens"), F.regexp_count(md, F.lit(r"(?m)^#{1,6} ")).alias("headings"),
        F.regexp_count(md, F.lit(r"\]\(")).alias("links"), F.regexp_count(md, F.lit("```")).alias("fences"), F.regexp_count(md, F.lit(r"(?m)(?:^\|.*\n?)+")).alias("tables"), F.left(md, F.lit(2000)).alias("markdown"),
    )
