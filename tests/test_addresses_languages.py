"""Addresses against the standard library, ranges and languages against brute force, charsets against Python's codecs."""

import ipaddress
import random
import socket
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.functions import addresses as A
from pagewright.functions import fixed as V
from pagewright.functions import outcomes as O
from pagewright.operators import languages as L
from pagewright.sources import charsets as C


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def digits(text):
    """The address that Python reads, as digits; None if it reads none."""
    bare = text.strip().strip("[]").partition("%")[0]
    try:
        ip = ipaddress.ip_address(bare)
        return A.MAPPED + f"{int(ip):08x}" if ip.version == 4 else f"{int(ip):032x}"
    except ValueError:
        pass
    try:
        return A.MAPPED + socket.inet_aton(bare).hex() if bare and " " not in bare else None
    except OSError:
        return None


def some_addresses(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        v6 = ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), rng.getrandbits(16) << 112, rng.getrandbits(20), 0xFFFF << 32 | rng.getrandbits(32)]))
        v4 = ipaddress.IPv4Address(rng.getrandbits(32))
        parts = [int(x) for x in str(v4).split(".")]
        forms = [str(v6), v6.exploded, f"[{v6}]", f"{v6}%eth0".upper(), str(v4), ".".join(rng.choice(["{}", "0{:o}", "0x{:x}", "0X{:X}"]).format(x) for x in parts), f"{parts[0]}.{int(v4) & 0xFFFFFF}", f"{parts[0]}.{parts[1]}.{int(v4) & 0xFFFF}", str(int(v4)), hex(int(v4)), f"::ffff:{v4}", f"64:ff9b::{v4}"]
        out.append(rng.choice(forms))
    return out


ODD = [
    "", "1", "1.2.3.4.5", "256.1.1.1", "1.2.3.256", "1.256.1", "08.1.1.1", "0x.1.1.1", "4294967296", "4294967295", "00000000000000000001", "1..2", ".1", "1.", "::", ":::", "::1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9",
    "1::2:3:4:5:6:7:8", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:", "12345::", "g::", "::1.2.3.4", "::ffff:1.2.3", "::ffff:256.1.1.1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::ffff:01.2.3.4", "fe80::1%1", "no", "1.2.3.4x", "é",
]


def test_addresses(spark):
    values = ODD + some_addresses(1, 400)
    assert dict(zip(values, column(spark, values, A.address), strict=True)) == {v: digits(v) for v in values}
    assert column(spark, [None], A.address) == [None]


def test_internal_addresses(spark):
    """Private, local, reserved and special ranges, on their ends and next to them; all others are public."""
    ends = [ipaddress.ip_network(x) for x in (*V.BLOCKED_RANGES, *V.BLOCKED_RANGES_V6, *V.PUBLIC_RANGES_V6)]
    values = [ip for n in ends for ip in (n.network_address, n.broadcast_address)]
    values += [type(ip)(int(ip) + d) for ip in values for d in (-1, 1) if 0 <= int(ip) + d < (1 << 32 if ip.version == 4 else 1 << 128)]

    def internal(ip):
        ip = getattr(ip, "ipv4_mapped", None) or ip
        inside = [ip in n for n in ends if n.version == ip.version and str(n) not in V.PUBLIC_RANGES_V6]
        allowed = any(ip in ipaddress.ip_network(x) for x in V.PUBLIC_RANGES_V6) if ip.version == 6 else False
        return any(inside) and not allowed

    found = column(spark, [str(v) for v in values], lambda c: A.is_internal(A.address(c)))
    assert found == [internal(v) for v in values]
    for v, f in zip(values, found, strict=True):
        real = getattr(v, "ipv4_mapped", None) or v
        if real.is_private or real.is_loopback or real.is_link_local or real.is_multicast or real.is_unspecified or real.is_reserved:
            assert f, v
    pins = [["8.8.8.8"], ["2606:4700::1"], ["8.8.8.8", "fd00::1"], ["::ffff:10.0.0.1"], ["no"], []]
    assert column(spark, pins, O.pinned_address, "array<string>") == ["8.8.8.8", "2606:4700::1", None, None, None, None]


def test_ranges(spark):
    rng = random.Random(2)
    ranges = []
    for _ in range(40):
        wide = rng.random() < 0.5
        lo = rng.getrandbits(32 if wide else 128)
        hi = lo + rng.choice([0, 1, 1 << 8, 1 << 20, 1 << 24, 1 << 113 if not wide else 3])
        ranges.append((A.MAPPED + f"{lo:08x}", A.MAPPED + f"{min(hi, (1 << 32) - 1):08x}") if wide else (f"{lo:032x}", f"{min(hi, (1 << 128) - 1):032x}"))
    ranges += [ranges[0], ("f" * 32, "0" * 32), (None, "1" * 32), (A.MAPPED + "ffffff00", "0" * 19 + "1" + "0" * 12)]
    fine = [r for r in ranges if r[0] is not None and r[0] <= r[1]]
    values = [x for r in fine for x in r] + [f"{rng.getrandbits(128):032x}" for _ in range(50)] + [A.MAPPED + f"{rng.getrandbits(32):08x}" for _ in range(50)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)] + [(-1, None)], "i int, address string")
    got = A.in_ranges(rows, spark.createDataFrame(ranges, "lo string, hi string")).collect()
    assert len(got) == len(rows.collect())
    for r in got:
        inside = r["address"] is not None and any(lo <= r["address"] <= hi for lo, hi in fine)
        assert (r["range_lo"] is not None) == inside and (not inside or r["range_lo"] <= r["address"] <= r["range_hi"])


def brute_profile(texts, top):
    counts = Counter(g for t in texts for g in grams(t))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[:top]]


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    whole = f" {' '.join(words)} "
    return [whole[i : i + 3] for i in range(len(whole) - 2)] if words else []


@pytest.mark.parametrize("top", [5, 300])
def test_languages_by_brute_force(spark, top):
    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "cdefg", "cc": "éñüß五"}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(rng.choices(list(letters), k=90))]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "12 !?", None), (103, "abc " * 20_000, None), (5, "again é", None), (104, "zzz", None)]
    table = spark.createDataFrame([(i, t, lang, "x") for i, t, lang in rows], "doc_id long, text string, lang string, gram string")
    known = L.profiles(table, top=top)
    wanted = {lang: brute_profile([t for _, t, x in rows if x == lang], top) for lang in letters}
    got = {}
    for r in known.orderBy("lang", "place").collect():
        got.setdefault(r["lang"], []).append(r["gram"])
    assert got == wanted
    found = sorted(((r["doc_id"], r["detected"], r["distance"]) for r in L.detected(table, known, top=top).collect()), key=str)
    out = []
    for i, t, _ in rows:
        own = brute_profile([t], top)
        sums = {lang: sum(abs(p.index(g) - k) if g in p else top for k, g in enumerate(own)) for lang, p in wanted.items()}
        meets = [lang for lang, p in wanted.items() if set(p) & set(own)]
        best = min(meets, key=lambda x: (sums[x], x), default=None)
        out.append((i, best, sums[best] if best else None))
    assert found == sorted(out, key=str)


def test_declared_language_comes_first(spark):
    declared = spark.createDataFrame([(1, "en"), (2, None), (3, None)], "page_id long, language string")
    found = spark.createDataFrame([(1, "de"), (2, "de"), (3, None)], "page_id long, detected string")
    got = L.with_language(declared, found).orderBy("page_id").collect()
    assert [(r["language"], r["language_source"], r["language_confidence"]) for r in got] == [("en", "declared", 1.0), ("de", "detected", 0.6), (None, None, None)]


TEXT = "<html><head>{}</head><body>Grüße, œuvre – “quoted” €</body></html>"


@pytest.mark.parametrize(
    "content,header,charset",
    [
        (TEXT.format("").encode(), None, "UTF-8"),
        (b"\xef\xbb\xbf" + TEXT.format("").encode(), "text/html; charset=koi8-r", "UTF-8"),
        (b"\xff\xfe" + TEXT.format("").encode("utf-16-le"), None, "UTF-16LE"),
        (b"\xfe\xff" + TEXT.format("").encode("utf-16-be"), None, "UTF-16BE"),
        (TEXT.format("").encode("cp1252"), "text/html; charset=ISO-8859-1", "windows-1252"),
        (TEXT.format('<meta charset="latin1">').encode("cp1252"), None, "windows-1252"),
        (TEXT.format('<META http-equiv=Content-Type content="text/html; charset=windows-1252">').encode("cp1252"), "text/html", "windows-1252"),
        ("<meta charset=koi8-r>Привет".encode("koi8-r"), "text/html; charset=unknown", "KOI8-R"),
        ("<meta charset='shift_jis'>日本語".encode("shift_jis"), None, "Shift_JIS"),
        ("<p>zażółć".encode("iso-8859-2"), "text/html;charset='iso-8859-2'", "ISO-8859-2"),
        ("<meta charset=gbk>中文".encode("gbk") + b"\xff", None, "GBK"),
        (b"bad \xff\xc3 utf", None, "UTF-8"),
        (b'<meta charset="utf-16">plain', None, "UTF-8"),
        (b"", None, "UTF-8"),
    ],
)
def test_charsets(spark, content, header, charset):
    row = spark.createDataFrame([(bytearray(content), header)], "c binary, h string").select(C.charset_of(F.col("c"), F.col("h")).alias("name"), C.decoded(F.col("c"), F.col("h")).alias("text")).first()
    codec = {"GBK": "gbk", "Shift_JIS": "shift_jis"}.get(charset, charset)
    assert row["name"] == charset and row["text"].removeprefix("﻿") == content.decode(codec, "replace").removeprefix("﻿")


def test_null_bytes(spark):
    assert spark.createDataFrame([(None,)], "c binary").select(C.decoded(F.col("c")).alias("t")).first()["t"] is None
