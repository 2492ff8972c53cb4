"""References resolved against a base address, as columns: RFC 3986, section 5, with dot segments folded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls as U

#: Scheme without colon, authority with //, path, query with ?, fragment with #; '' is what isn't there.
_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
_FIELDS = ("scheme", "authority", "path", "query", "fragment")
_NO_LINKS = r"(?i)^(javascript|mailto|tel|data):"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named: a plan would copy it to every place."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once: an element of an array of one, into which no plan is merged."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def cleaned(reference: Column) -> Column:
    """Without blanks and control characters around it, and without tabs and line ends inside."""
    return F.regexp_replace(F.regexp_replace(reference, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\r\n]", "")


def parts(reference: Column) -> Column:
    found = [F.regexp_extract(reference, _REFERENCE, i + 1) for i in range(5)]
    return F.struct(F.lower(found[0]).alias("scheme"), *(x.alias(name) for x, name in zip(found[1:], _FIELDS[1:], strict=True)))


def without_dots(path: Column) -> Column:
    """A path without '.' and '..' segments; none leads above the root."""

    def folded(pieces: Column, start: str) -> Column:
        kept = F.aggregate(
            pieces,
            F.array().cast("array<string>"),
            lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x)),
        )
        folder = F.element_at(pieces, -1).isin(".", "..")
        return let(kept, lambda k: F.concat(F.lit(start), F.array_join(k, "/"), F.when(folder & (F.size(k) > 0), "/").otherwise("")))

    plain = ~F.contains(path, F.lit("/.")) & ~path.startswith(".")
    return F.when(plain, path).when(path.startswith("/"), folded(F.split(F.substring(path, 2, 1 << 30), "/"), "/")).otherwise(folded(F.split(path, "/"), ""))


def resolved(base: Column, reference: Column) -> Column:
    """The address that a reference means; ``base``: ``parts`` of an address with scheme and authority.

    A reference that has the base's scheme but no authority is relative, as browsers have it.
    """
    return let(base, lambda b: let(parts(cleaned(reference)), lambda r: _resolved(b, r)))


def _resolved(b: Column, r: Column) -> Column:
    relative = (r["scheme"] == "") | ((r["scheme"] == b["scheme"]) & (r["authority"] == ""))
    own = relative & (r["authority"] == "")
    folder = F.when(b["path"] == "", F.lit("/")).otherwise(F.regexp_extract(b["path"], r"(?s)^(.*/)", 1))
    merged = F.when(own & ~r["path"].startswith("/"), F.concat(folder, r["path"])).otherwise(r["path"])
    path = F.when(own & (r["path"] == ""), b["path"]).otherwise(let(merged, without_dots))
    query = F.when(own & (r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
    scheme = F.when(relative, b["scheme"]).otherwise(r["scheme"])
    authority = F.when(own, b["authority"]).otherwise(r["authority"])
    return F.concat(scheme, F.lit(":"), authority, path, query, r["fragment"])


def is_web(url: Column) -> Column:
    """Whether an absolute address is http or https and names a host, in a form that a host can have."""
    return F.coalesce(url.rlike(r"(?i)^https?://(?:[^/?#]*@)?(?:\[[0-9a-f:.]+\]|[^/?#:@.\[\]\s][^/?#:@\[\]\s]*)(?::\d*)?(?:[/?#]|$)"), F.lit(False))


def effective_base(page: Column, declared: Column) -> Column:
    """A page's base address: the declared one, resolved against the page's own, if that is a web address."""
    return F.when(cleaned(F.coalesce(declared, F.lit(""))) == "", page).otherwise(let(resolved(parts(page), declared), lambda x: F.when(is_web(x), x).otherwise(page)))


def link_kind(reference: Column, url: Column, page_host: Column) -> Column:
    """anchor, internal or external; null for what is no web link. ``url``: the resolved reference."""
    return let(
        cleaned(reference),
        lambda bare: F.when(bare.startswith("#"), "anchor")
        .when((bare == "") | bare.rlike(_NO_LINKS) | ~is_web(url), F.lit(None))
        .when(U.host(url) == page_host, "internal")
        .otherwise("external"),
    )


def link_lists(hrefs: Column, base: Column, page: Column) -> Column:
    """(anchors, internal, external): a page's links, each once, in order of first sight; ``base``: its base address."""

    def found(b: Column, own: Column) -> Column:
        targets = F.transform(hrefs, lambda h: F.struct(cleaned(h).alias("href"), resolved(b, h).alias("url")))
        return F.transform(targets, lambda x: F.struct(x["href"].alias("href"), x["url"].alias("url"), link_kind(x["href"], x["url"], own).alias("kind")))

    def lists(links: Column) -> Column:
        def of(kind: str, name: str) -> Column:
            return F.array_distinct(F.transform(F.filter(links, lambda x: x["kind"] == kind), lambda x: x[name]))

        return F.struct(of("anchor", "href").alias("anchors"), of("internal", "url").alias("internal"), of("external", "url").alias("external"))

    return let(F.struct(parts(base).alias("base"), U.host(page).alias("host")), lambda o: let(found(o["base"], o["host"]), lists))
