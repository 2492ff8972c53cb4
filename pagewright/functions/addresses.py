"""Internet addresses of both kinds as one ordered column, and tables of ranges that are looked up by an equi-join.

An address is a text of 32 hexadecimal digits, so that the order of texts is that of addresses; an IPv4 address has the
digits of its mapped IPv6 form. Read are IPv6 texts with ``::``, an IPv4 tail, brackets and a zone, and IPv4 texts of one
to four parts, each decimal, octal (0...) or hexadecimal (0x...), of which the last one fills what is left.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import fixed as V
from pagewright.functions import urls as U
from pagewright.functions.resolution import held, let

MAPPED = "0" * 20 + "ffff"
#: Digits that a lookup joins by: 8 bits of an IPv4 address, 16 of an IPv6 address.
V4_DIGITS, V6_DIGITS = len(MAPPED) + 2, 4
_PART = r"(?:0[xX][0-9a-fA-F]+|\d+)"


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def _v4_part(text: Column) -> Column:
    """A part's number, null if it is none or has more than 32 bits."""
    hexed, octal = text.rlike("^0[xX]"), text.rlike(r"^0\d")
    bare = F.regexp_replace(F.when(hexed, F.substring(text, 3, 64)).otherwise(text), "^0+(?=.)", "")
    fine = F.when(hexed, F.length(bare) <= 8).when(octal, bare.rlike("^[0-7]{1,11}$")).otherwise(F.length(bare) <= 10)
    base10 = F.when(hexed, F.conv(bare, 16, 10)).when(octal, F.conv(bare, 8, 10)).otherwise(bare)
    return F.when(fine, base10.try_cast("bigint"))


def ipv4_number(text: Column) -> Column:
    """The number that an IPv4 text of any of its forms means, or null."""

    def of(parts: Column) -> Column:
        n = F.size(parts)
        most = F.element_at(F.array(*(F.lit(x) for x in ((1 << 32) - 1, (1 << 24) - 1, (1 << 16) - 1, 255))), n)
        small = F.forall(F.slice(parts, 1, n - 1), lambda x: x.isNotNull() & (x <= 255))
        last = F.element_at(parts, -1)
        head = F.aggregate(F.slice(parts, 1, n - 1), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1 << 24).cast("long").alias("unit")), lambda s, x: F.struct((s["sum"] + x * s["unit"]).alias("sum"), (s["unit"] / 256).cast("long").alias("unit")), lambda s: s["sum"])
        return F.when(small & last.isNotNull() & (last <= most), head + last)

    return F.when(text.rlike(rf"^{_PART}(?:\.{_PART}){{0,3}}$"), let(F.transform(F.split(text, r"\."), _v4_part), of))


def _v6_digits(text: Column) -> Column:
    """The 32 digits of an IPv6 text of lower-case groups, or null."""

    def filled(sides: Column) -> Column:
        groups = [F.filter(F.split(F.get(sides, F.lit(i)), ":"), lambda g: g != "") for i in (0, 1)]
        both = F.coalesce(groups[1], F.array().cast("array<string>"))
        missing = 8 - F.size(groups[0]) - F.size(both)
        every = F.concat(groups[0], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), both)
        count = F.when(F.size(sides) == 1, missing == 0).when(F.size(sides) == 2, missing >= 1).otherwise(F.lit(False))
        # No side has an empty group: a single colon at an end, or three in a row.
        tidy = F.forall(sides, lambda x: ~x.rlike("^:|:$|::"))
        fine = count & tidy & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(fine, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    return let(F.split(text, "::"), filled)


def address(text: Column) -> Column:
    """The 32 digits of an address; null if the text is no address."""

    def of(bare: Column) -> Column:
        tail = F.regexp_extract(bare, r"^[0-9a-f:]*:(\d{1,3}(?:\.\d{1,3}){3})$", 1)

        def with_tail(n: Column) -> Column:
            groups = F.concat(F.regexp_extract(bare, r"^([0-9a-f:]*:)[\d.]+$", 1), _hex(F.shiftright(n, 16), 4), F.lit(":"), _hex(n.bitwiseAND(F.lit(65535)), 4))
            return F.when(n.isNotNull() & ~tail.rlike(r"(?:^|\.)0\d"), _v6_digits(groups))

        v6 = F.when(tail != "", let(ipv4_number(tail), with_tail)).otherwise(_v6_digits(bare))
        return F.when(bare.rlike("^[0-9a-f:.]*:[0-9a-f:.]*$"), v6).otherwise(F.concat(F.lit(MAPPED), _hex(ipv4_number(bare), 8)))

    return let(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"^\[|\]$", ""), r"%.*$", ""), of)


def cidr_bounds(cidr: str) -> tuple[str, str]:
    """First and last address of a range, as digits."""
    net = ipaddress.ip_network(cidr)
    ends = (int(net.network_address), int(net.broadcast_address))
    return tuple(MAPPED + f"{x:08x}" if net.version == 4 else f"{x:032x}" for x in ends)


def is_internal(digits: Column) -> Column:
    """Whether an address is none of the public net; IPv4 inside IPv6 counts as itself. Null for null."""
    v4 = reduce(lambda a, b: a | b, [digits.between(*cidr_bounds(x)) for x in V.BLOCKED_RANGES])
    v6 = reduce(lambda a, b: a | b, [digits.between(*cidr_bounds(x)) for x in V.BLOCKED_RANGES_V6])
    allowed = reduce(lambda a, b: a | b, [digits.between(*cidr_bounds(x)) for x in V.PUBLIC_RANGES_V6])
    return F.when(digits.startswith(MAPPED), v4).otherwise(v6 & ~allowed)


def _prefix(digits: Column) -> Column:
    return F.when(digits.startswith(MAPPED), F.left(digits, F.lit(V4_DIGITS))).otherwise(F.left(digits, F.lit(V6_DIGITS)))


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """(prefix, lo, hi) of ranges (lo, hi): by prefix, those that overlap or touch made one, cut at the prefix's ends.

    A range makes a row for each of its prefixes, 65,792 at most; windows follow one prefix each. Rows that are no
    range, because an end is missing or the last comes before the first, make none.
    """
    whole = ranges.where("lo <= hi").select("lo", "hi")
    v4 = whole.where((F.col("hi") >= MAPPED + "0" * 8) & (F.col("lo") <= MAPPED + "f" * 8))
    v4 = v4.select(F.greatest("lo", F.lit(MAPPED + "0" * 8)).alias("lo"), F.least("hi", F.lit(MAPPED + "f" * 8)).alias("hi"))
    end = [F.conv(F.substring(c, len(MAPPED) + 1, 2), 16, 10).cast("int") for c in ("lo", "hi")]
    v4 = v4.select("lo", "hi", F.explode(F.sequence(*end)).alias("n")).select("lo", "hi", F.concat(F.lit(MAPPED), _hex(F.col("n"), 2)).alias("prefix"))
    end = [F.conv(F.left(c, F.lit(V6_DIGITS)), 16, 10).cast("int") for c in ("lo", "hi")]
    v6 = whole.where(~(F.col("lo").startswith(MAPPED) & F.col("hi").startswith(MAPPED))).select("lo", "hi", F.explode(F.sequence(*end)).alias("n"))
    v6 = v6.select("lo", "hi", _hex(F.col("n"), V6_DIGITS).alias("prefix"))
    cut = v4.unionByName(v6).select("prefix", F.greatest("lo", F.rpad("prefix", 32, "0")).alias("lo"), F.least("hi", F.rpad("prefix", 32, "f")).alias("hi"))
    before = Window.partitionBy("prefix").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("prefix").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max("hi").over(before)
    marked = cut.withColumn("new", (reach.isNull() | (reach < F.col("lo"))).cast("int")).withColumn("part", F.sum("new").over(upto))
    return marked.groupBy("prefix", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("prefix", "lo", "hi")


def in_ranges(rows: DataFrame, ranges: DataFrame, digits: str = "address") -> DataFrame:
    """``rows`` with ``range_lo`` and ``range_hi``, the merged range that holds the address; null if none does.

    A row meets the few merged ranges of its prefix only, and of those, which don't overlap, one at most is its own.
    """
    table = merged_ranges(ranges).select(F.col("prefix").alias("__prefix"), F.col("lo").alias("range_lo"), F.col("hi").alias("range_hi"))
    keyed = rows.withColumn("__prefix", _prefix(F.col(digits)))
    inside = (keyed["__prefix"] == table["__prefix"]) & (keyed[digits] >= table["range_lo"]) & (keyed[digits] <= table["range_hi"])
    return keyed.join(table, inside, "left").drop("__prefix")


def fetch_refusal(url: Column) -> Column:
    """Why a URL may not be fetched, or null; hosts are judged by name and by addresses of both kinds and all forms."""

    def of(trimmed: Column) -> Column:
        name = U.host(trimmed)
        return (
            F.when(trimmed.isNull() | (trimmed == ""), "empty")
            .when(trimmed.rlike(r"[\r\n\x00]"), "control characters")
            .when(~U.scheme(trimmed).isin("http", "https"), "scheme")
            .when(name == "", "host")
            .when((U.port(trimmed) < 1) | (U.port(trimmed) > 65535), "port")
            .when(name.isin(V.BLOCKED_HOSTS), "blocked host")
            .when(name.rlike(r"^(0x[0-9a-f]+|0[0-7]+|\d+)$"), "numeric host")
            .when(let(address(name), is_internal), "blocked address")
        )

    return let(F.trim(url), of)
