"""Main text of pages by site style trees.

The element trees of a site's pages are merged: elements with the same path of tags, classes, ids and roles from the root
are one node (words with digits, and what ``html`` and ``body`` are called, differ from page to page and don't count; a
node's name is a hash of its parent's name and its own label, so a page takes memory by its elements, however deep they
lie), which knows in how many pages it occurs, how often each sequence of children (its style) and each text block
occurs. For a node of m > 1 pages

* presentation importance is the entropy, to base m, of its styles over those pages (1 if every page differs, 0 if all
  are alike);
* content importance is 1 minus the mean, over its text blocks, of each block's entropy, to base m, over the pages that
  have it (0 if every block is in every page);
* a block's importance is the mean of its own node's content importance and its parent's presentation importance, times
  ``NAMED`` for branches that markup itself names as menus, adverts, footers and the like.

Pages lose the blocks below ``THRESHOLD``. The same figures over the tree of all sites merged count as ``PRIOR`` pages more,
beside the m - 1 that a site's own tree compares: a site of one page has those alone, a large site its own. A node that
no other page has, of any site, has no figures, so there only the markup's own names count.

Copies of a page, on one site or on several, are one page of the trees; every copy gets its text.

Pages are parsed once, on the executors, into nodes (64-bit names of paths), features and texts, and written to the shared
folder. (site, page, node, feature) rows are made distinct and then counted, so a site with most pages or a page with
many copies is no single task. Pages of a site that have the same nodes share a layout: the unimportant nodes are joined
to the nodes of each layout, and the list of each layout's nodes that go is joined to the pages, broadcast up to
``BROADCAST_KEYS`` nodes in all, and shuffled beyond. What many rows share is dealt in ``SALTS`` parts in both joins.
Nothing of the trees goes to the driver but that count.

Defined results: a null or empty html has an empty text; a url that is null or has no host belongs to a site of its own
kind, ''; rows that repeat a page are extracted each; an empty table gives an empty result; unclosed and unmatched tags
are tolerated: a hidden element without an end tag hides what comes before the next block or the end of its parent; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagewright.llm.base import arrow_rows, cut, remove

THRESHOLD = 0.35
#: Pages that the tree of all sites counts for, beside a site's own.
PRIOR = 1
#: Factor on the importance of branches that the markup names as something other than the article. Such a branch stays
#: from an importance of 0.7 on: more than its own content alone, which rotating adverts have too, can give.
NAMED = 0.5
#: Parts into which the rows of one node of a site, or of one layout, are dealt.
SALTS = 16
#: Name of what stands outside all elements.
ROOT = 0
#: Nodes (8 bytes each) of all layouts' lists up to which these are broadcast.
BROADCAST_KEYS = 1_000_000

# Element names of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("script style noscript template svg iframe object canvas form button select textarea audio video".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
#: Hidden elements that may lie in one another; of the others, a second start shows that the first was not closed.
_NESTING = frozenset("template svg object".split())
_BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address header footer nav aside details summary hr fieldset center".split()
)
_NAMED_TAGS = frozenset("nav footer aside menu".split())
_NAMED_WORDS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer sidebar aside widget related share social cookie cookies consent notice popup "
    "modal newsletter subscribe comment comments reply replies disqus".split()
)
#: Their own class, id or role never marks them. Articles can be in a marked branch (teasers, comments), the others not.
_CONTENT = frozenset("body main article".split())
_CLOSES = {  # an opening tag ends these if they are innermost
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_DIGIT = re.compile(r"\d")
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def _telling(name: str) -> bool:
    found = re.findall(r"[^\W\d_]+", name)
    return bool(found) and _NAMED_WORDS.issuperset(found)


class Block(NamedTuple):
    node: int  # name of the element that holds the text: a hash of its path
    parent: int
    named: bool  # the markup names the branch as something other than the article
    text: str


def _name(text: str, parent: int = 0) -> int:
    """A 63-bit name; of an element, from its label and its parent's name."""
    return xxh64_intdigest(text, parent) >> 1


def parse(html: str) -> tuple[list[Block], dict[int, set[str]]]:
    """The text blocks of a page in order, and for each node the styles (children's sequences) it has in the page."""
    blocks: list[Block] = []
    styles: dict[int, set[str]] = {}
    stack: list[tuple[str, int, bool, list[str]]] = [("", ROOT, False, [])]  # tag, node, named, children
    held: Counter[str] = Counter()  # tags in the stack
    words: list[str] = []
    hidden, depth, endless = "", 0, False
    inside: list[str] = []  # blocks open in the hidden element
    within: Counter[str] = Counter()  # their tags
    ends: dict[str, tuple[int, int]] = {}

    def end_of(tag: str) -> tuple[int, int]:
        """The next end tag from ``at`` on, (-1, -1) if there is none."""
        if tag not in ends or 0 <= ends[tag][0] < at:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            ends[tag] = end.span() if end else (-1, -1)
        return ends[tag]

    def unclosed(tag: str) -> bool:
        until = end_of(tag)[0]
        return until < 0 or tag not in _NESTING and bool(re.compile(rf"<{tag}(?=[\s/>])", re.I).search(html, at, until))

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append(Block(stack[-1][1], stack[-2][1] if len(stack) > 1 else ROOT, stack[-1][2], text))

    def pop() -> None:
        tag, node, _, children = stack.pop()
        held[tag] -= 1
        styles.setdefault(node, set()).add(" ".join(children))

    at = 0
    while True:
        found = _MARKUP.search(html, at)
        if not hidden:
            words.append(entities.unescape(html[at : found.start() if found else len(html)]))
        if not found:
            break
        at = found.end()
        closing, tag, rest = found.group(1), (found.group(2) or "").lower(), found.group(3) or ""
        if not tag:
            continue
        if tag in _RAW and not closing and end_of(tag)[0] >= 0:
            at = at if rest.rstrip().endswith("/") else end_of(tag)[1]
            continue
        if hidden:
            if tag == hidden and (closing or tag in _NESTING and not endless):
                depth += -1 if closing else 1
                hidden = hidden if depth else ""
                continue
            if closing and within[tag]:
                while True:
                    last = inside.pop()
                    within[last] -= 1
                    if last == tag:
                        break
                continue
            # It ends with an element around it; if it has no end tag of its own, also at the next block or of its kind.
            if closing and tag in _BLOCK and held[tag] or not closing and endless and (tag in _BLOCK or tag == hidden):
                hidden = ""
            else:
                if not closing and tag in _BLOCK and tag not in _VOID:
                    inside.append(tag)
                    within[tag] += 1
                continue
        if tag in _HIDDEN or tag in _RAW:
            if not closing and not rest.rstrip().endswith("/"):
                hidden, depth, endless = tag, 1, unclosed(tag)
                inside.clear()
                within.clear()
            continue
        if tag == "br":
            words.append(" ")
        if tag not in _BLOCK:
            continue
        flush()
        if closing:
            if held[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        while len(stack) > 1 and stack[-1][0] in _CLOSES.get(tag, {"p"}):
            pop()
        names = sorted({x for _, value in _NAMES.findall(rest) for x in re.findall(r"[^\W_]+", value.lower())}) if rest else []
        label = tag + "".join(f".{x}" for x in names if tag not in ("html", "body") and not _DIGIT.search(x))
        stack[-1][3].append(label)
        if tag in _VOID or rest.rstrip().endswith("/"):
            continue
        # A class, id or role tells if all its words do: neither "with-sidebar" nor "ad-free-article" names a sidebar or ad.
        telling = bool(names) and any(_telling(x) for _, value in _NAMES.findall(rest) for x in value.strip("\"'").lower().split())
        in_article = held["article"] or held["main"]
        named = stack[-1][2] or tag in _NAMED_TAGS or tag == "header" and not in_article or telling
        if tag in _CONTENT:
            named = tag == "article" and stack[-1][2]
        held[tag] += 1
        stack.append((tag, _name(label, stack[-1][1]), named, []))
    flush()
    while stack:
        pop()
    return blocks, styles


def host_of(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


PARSED = "page_id long, url string, host string, page long, keys array<long>, parents array<long>, features array<long>, texts array<string>, styled array<long>, styles array<long>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a hash of the html, the same for all copies), and what the page holds, as arrays.

    Of each block: its key, which is the node, or ~node (negative) if the markup names the branch; its node's parent; the
    text's hash; the text. Of each node: its name and the hash of its styles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, parents, features, texts, styled, styles, of_page = [], [], [], [], [], [], []
            at, styled_at = [0], [0]
            for html in batch.column(3).to_pylist():
                blocks, own = parse(html or "")
                of_page.append(_name(html or ""))
                for b in blocks:
                    keys.append(~b.node if b.named else b.node)
                    parents.append(b.parent)
                    features.append(_name(b.text))
                    texts.append(b.text)
                for node, children in own.items():
                    styled.append(node)
                    styles.append(_name(" | ".join(sorted(children))))
                at.append(len(keys))
                styled_at.append(len(styled))
            lists = [(keys, pa.int64(), at), (parents, pa.int64(), at), (features, pa.int64(), at), (texts, pa.string(), at), (styled, pa.int64(), styled_at), (styles, pa.int64(), styled_at)]
            columns = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind)) for values, kind, offsets in lists]
            names = [x.split()[0] for x in PARSED.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(of_page, pa.int64()), *columns], names=names)

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, PARSED)


def node_of(key: str) -> F.Column:
    return F.when(F.col(key) < 0, F.bitwise_not(F.col(key))).otherwise(F.col(key))


def tree_rows(parsed: DataFrame) -> DataFrame:
    """host, page, node, parent (null: a style, else a text), feature: each distinct one of a page once."""
    texts = parsed.select("host", "page", F.explode(F.arrays_zip("keys", "parents", "features")).alias("x")).select("host", "page", "x.*")
    texts = texts.select("host", "page", node_of("keys").alias("node"), F.col("parents").alias("parent"), F.col("features").alias("feature"))
    styles = parsed.select("host", "page", F.explode(F.arrays_zip("styled", "styles")).alias("x"))
    styles = styles.select("host", "page", F.col("x.styled").alias("node"), F.lit(None).cast("long").alias("parent"), F.col("x.styles").alias("feature"))
    return texts.unionByName(styles).distinct()


def importance(rows: DataFrame, site: list[str]) -> DataFrame:
    """(*site, node, m, importance) of the text nodes of each tree; rows hold in how many pages (n) a feature occurs."""
    # Every page that has a node has one row of its style, so those rows count the pages.
    style = rows.where("parent is null").groupBy(*site, "node").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    m = F.col("m")
    style = style.withColumn("presentation", F.when(m > 1, (F.log(m) - F.col("nlogn") / m) / F.log(m)).otherwise(1.0))
    looks = style.select(*site, F.col("node").alias("parent"), "presentation")
    # A block in n of m pages counts n times in the mean, as n pages hold it.
    text = rows.where("parent is not null").groupBy(*site, "node", "parent").agg(F.sum("n").alias("blocks"), F.sum(F.col("n") * F.log("n")).alias("repeats"))
    text = text.join(style.select(*site, "node", "m"), [*site, "node"]).join(looks, [*site, "parent"])
    content = F.when(m > 1, 1 - F.col("repeats") / F.col("blocks") / F.log(m)).otherwise(1.0)
    return text.select(*site, "node", "m", ((content + F.col("presentation")) / 2).alias("importance"))


def unimportant(parsed: DataFrame) -> DataFrame:
    """The text nodes below the threshold, (host, node, bare).

    ``bare``: below it even if the markup doesn't name the branch; else only with ``NAMED``.
    """
    seen = cut(tree_rows(parsed), "trees")
    own = importance(seen.groupBy("host", "node", "parent", "feature").agg(F.count("*").alias("n")), ["host"])
    every = importance(seen.groupBy("node", "parent", "feature").agg(F.countDistinct("page").alias("n")), [])
    both = own.join(every.select("node", F.col("m").alias("m_all"), F.col("importance").alias("of_all")), "node")
    weight, prior = F.col("m") - 1, F.when(F.col("m_all") > 1, F.lit(PRIOR)).otherwise(F.lit(0))
    # No figures: the markup's names decide.
    known = weight + prior > 0
    mean = F.when(known, (weight * F.col("importance") + prior * F.col("of_all")) / (weight + prior)).otherwise(1.0)
    low = both.select("host", "node", mean.alias("mean"), known.alias("known")).where(~F.col("known") | (F.col("mean") * NAMED < THRESHOLD))
    out = cut(low.select("host", "node", (F.col("mean") < THRESHOLD).alias("bare")), "unimportant")
    remove(parsed.sparkSession, seen)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    arrow_rows(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of("url").alias("host"), "html")
    layout = F.xxhash64(F.array_sort(F.array_distinct("keys")))
    parsed = cut(parsed_pages(rows).withColumn("layout", layout).withColumn("row", F.monotonically_increasing_id()), "parsed")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    low = unimportant(parsed).withColumn("salt", salts)
    layouts = parsed.groupBy("host", "layout").agg(F.first(F.array_distinct("keys")).alias("keys"))
    has = layouts.select("host", "layout", F.pmod("layout", F.lit(SALTS)).cast("int").alias("salt"), F.explode("keys").alias("key"))
    gone = has.withColumn("node", node_of("key")).join(low, ["host", "node", "salt"]).where((F.col("key") < 0) | F.col("bare"))
    dropped = cut(gone.groupBy("host", "layout").agg(F.collect_list("key").alias("dropped")), "dropped")
    texts = parsed.select("host", "layout", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), "page_id", "url", "keys", "texts")
    if (dropped.agg(F.sum(F.size("dropped"))).first()[0] or 0) <= BROADCAST_KEYS:
        joined = texts.join(F.broadcast(dropped), ["host", "layout"], "left")
    else:
        joined = texts.join(dropped.withColumn("salt", salts), ["host", "layout", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for keys, texts, dropped in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                gone = set(dropped or ())
                kept.append("\n\n".join(text for key, text in zip(keys, texts, strict=True) if key not in gone))
            columns = [batch.column(0), batch.column(1), pa.array(kept, pa.string()), pa.array([len(x) for x in kept], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "keys", "texts", "dropped").mapInArrow(run, "page_id long, url string, text string, n_chars long")
