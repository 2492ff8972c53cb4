"""What a failed or blocked request means: retries, statuses, what a client may read, and whether it may be fetched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed as V
from pagewright.functions.addresses import address, is_internal
from pagewright.functions.resolution import let
from pagewright.functions import urls as U


def is_html(content_type: Column) -> Column:
    """Whether a content type is a page's, whatever its parameters; a missing one is not."""
    bare = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.coalesce(bare.isin(V.HTML_TYPES), F.lit(False))


def class_name(error_type: Column) -> Column:
    """The name of an exception's class, without its module."""
    return F.regexp_extract(F.coalesce(error_type, F.lit("")), r"([^.]*)$", 1)


def is_retryable(error_type: Column, status: Column) -> Column:
    """A retry may mend timeouts, lost connections and some statuses; a block by policy is final."""
    name = class_name(error_type)
    by_status = (name == "HTTPStatusError") & F.coalesce(status.isin(V.RETRYABLE_STATUSES), F.lit(False))
    return (name != "PolicyBlockedError") & (name.isin(V.RETRYABLE_ERRORS) | by_status)


def http_status(error_type: Column, error: Column, status: Column) -> Column:
    """The status that a failure is answered with; null for an internal error.

    Classes come first, in their order, then messages of the queue, then an upstream status: 400 to 499 stay as they
    are, others become 502.
    """
    name, message = class_name(error_type), F.coalesce(error, F.lit(""))
    out = F.when((name == "ImportError") & reduce(lambda a, b: a | b, [message.startswith(x) for x in V.RENDER_MESSAGES]), 400)
    for names, code in V.ERROR_STATUSES:
        out = out.when(name.isin(names), code)
    out = out.when(message == V.QUEUE_FULL, 429)
    out = out.when((name == "DatabaseError") | message.isin(V.QUEUE_UNAVAILABLE) | message.startswith(V.QUEUE_READ_FAILED), 503)
    out = out.when(name == "HTTPStatusError", F.when(status.between(400, 499), status).otherwise(502))
    return out.when(name == "PolicyBlockedError", 403).cast("int")


def public_error(error: Column, error_type: Column) -> Column:
    """What a client may read of an error; null stays null."""
    name, low = class_name(error_type), F.lower(error)
    marked = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in V.PRIVATE_MARKERS])
    return (
        F.when(error.isNull(), F.lit(None))
        .when(name == "PolicyBlockedError", "Content blocked by security policy")
        .when(name == "ValueError", "Invalid request")
        .when(name.isin(V.PRIVATE_ERRORS), "Internal server error")
        .when(marked, "Invalid request")
        .otherwise(error)
    )


def skip_render(tokens: Column, threshold: Column, url: Column, has_browser: Column) -> Column:
    """Whether a page fetched in the fast way needs no browser: long enough, none there, not a page or a sign-in page."""
    return (tokens >= threshold) | ~has_browser | U.is_non_html(url) | U.is_auth_page(url)


def pinned_address(addresses: Column) -> Column:
    """The first of a host's addresses, of either kind, if every one of them is public; else null."""
    public = F.forall(addresses, lambda x: F.coalesce(~let(address(x), is_internal), F.lit(False)))
    return F.when((F.size(addresses) > 0) & public, F.get(addresses, F.lit(0)))


def cost_units(renders: Column, budget: Column) -> Column:
    """(cost, exceeded): a fast fetch costs 1, a page with renders at most 5; beyond a budget that is given it fails."""
    cost = F.least(F.lit(5), F.lit(1) + F.coalesce(renders, F.lit(0)))
    return F.struct(cost.alias("cost"), F.coalesce(cost > budget, F.lit(False)).alias("exceeded"))


def throttled(interval: Column, status: Column, factor: float = 2.0, most: float = 60.0) -> Column:
    """A host's interval after an answer: longer by ``factor`` after 403 and 429, up to ``most`` seconds."""
    return F.when(status.isin(403, 429), F.least(F.lit(most), F.greatest(interval, F.lit(1.0)) * factor)).otherwise(interval)


def union_of_flags(*flags: Column) -> Column:
    """Each flag once, in the order of first sight; a missing list counts as empty."""
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in flags)))


def emitted_formats(requested: Column, available: Column) -> Column:
    """The formats a document is given out in: those asked for, then the usual ones, as far as there are any."""
    usual = F.array(*[F.lit(x) for x in V.OUTPUT_FORMATS])
    return F.array_distinct(F.filter(F.concat(requested, usual), lambda x: F.array_contains(available, x)))
