"""Table functions for SQL: a page's blocks and links as rows, by LATERAL or over a partitioned table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from pagewright.functions import dom as D


def _content(html: str | None) -> tuple[D.Node, str] | None:
    """A page's main content without hidden and unwanted parts, and the base that it declares; null if it can't be read."""
    if not (html or "").strip():
        return None
    try:
        root = D.parse(html)
        base = D.base_href(root)
        D.remove_hidden(root)
        found = D.main_content(root)
        D.remove_tags(found, D.UNWANTED)
        D.sanitize(found)
        return found, base
    except (ValueError, AssertionError, RecursionError):
        return None


class PageBlocks:
    """``page_blocks(html)``: the blocks of a page in order; none for a page that is null, blank or can't be read."""

    def eval(self, html: str) -> Iterator[tuple]:
        found = _content(html)
        for i, b in enumerate(D.blocks(found[0]) if found else ()):
            yield i, b["block_type"], b["level"], b["text"], b["markdown"]


class PageLinks:
    """``page_links(TABLE(pages) PARTITION BY ...)``: the references of each page as they are written, and its base.

    The table has page_id, url and html. Rows come one by one and nothing is kept between them, so a partition may be
    of any size. ``functions.resolution`` resolves the references in columns.
    """

    def eval(self, row: Row) -> Iterator[tuple]:
        found = _content(row["html"])
        for i, href in enumerate(D.hrefs(found[0]) if found else ()):
            yield row["page_id"], row["url"], i, href, found[1]


def register(spark: SparkSession) -> None:
    """Make ``page_blocks`` and ``page_links`` known to a session's SQL."""
    spark.udtf.register("page_blocks", udtf(PageBlocks, returnType="ordinal int, block_type string, level int, text string, markdown string"))
    spark.udtf.register("page_links", udtf(PageLinks, returnType="page_id long, url string, position int, href string, base_href string"))
