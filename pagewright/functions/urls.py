"""URL columns: parts, identity, tracking parameters, what may be fetched, what resources are blocked."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import fixed as V

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """The host in lower case, without user, port, brackets and trailing dots."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r":\d*$", ""), r"^\[|\]$", "")
    return F.regexp_replace(F.lower(bare), r"\.+$", "")


def port(url: Column) -> Column:
    digits = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)(?:[/?#]|$)", 1)
    return F.nullif(digits, F.lit("")).try_cast("int")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"#(.*)$", 1)


def identity(url: Column) -> Column:
    """Scheme and host in lower case, no default port, '/' for an empty path, no fragment; a user stays."""
    user = F.regexp_extract(authority(url), r"^(.*@)", 1)
    number = port(url)
    standard = ((scheme(url) == "http") & (number == 80)) | ((scheme(url) == "https") & (number == 443))
    suffix = F.when(number.isNull() | standard, "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    where = F.when(path(url) == "", "/").otherwise(path(url))
    asked = F.when(query(url) == "", "").otherwise(F.concat(F.lit("?"), query(url)))
    return F.concat(scheme(url), F.lit("://"), user, host(url), suffix, where, asked)


def without_tracking(url: Column) -> Column:
    """Parameters that only track go; a URL that has none of them stays as it is."""
    kept = F.filter(F.split(query(url), "&"), lambda p: ~F.lower(F.split(p, "=")[0]).isin(V.TRACKING_PARAMETERS))
    rest = F.array_join(kept, "&")
    before = F.regexp_extract(url, r"^([^?#]*)", 1)
    after = F.regexp_extract(url, r"(#.*)$", 1)
    rebuilt = F.concat(before, F.when(rest == "", "").otherwise(F.concat(F.lit("?"), rest)), after)
    return F.when(F.size(kept) == F.size(F.split(query(url), "&")), url).otherwise(rebuilt)


def is_non_html(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(V.NON_HTML_EXTENSIONS) + ")$")


def is_auth_page(url: Column) -> Column:
    """A label of the host or a segment of the path is a sign-in word; the query doesn't count."""
    parts = F.concat(F.split(host(url), r"\."), F.split(F.lower(path(url)), "/"))
    return F.arrays_overlap(parts, F.array(*[F.lit(x) for x in V.AUTH_PARTS]))


def range_bounds(cidr: str) -> tuple[int, int]:
    net = ipaddress.ip_network(cidr)
    return int(net.network_address), int(net.broadcast_address)


def ipv4_value(text: Column) -> Column:
    """Dotted IPv4 text as a number, or null."""
    octets = F.split(text, r"\.")
    each = [F.element_at(octets, i + 1).try_cast("bigint") for i in range(4)]
    fine = text.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(fine, each[0] * 16777216 + each[1] * 65536 + each[2] * 256 + each[3])
