"""Exact search against brute force; archives by round trip and by hand-made gzip members."""

import base64
import gzip
import hashlib
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from pagewright.llm import topk_search as K
from pagewright.llm import warc as W

VECTORS = "vec_id long, embedding array<float>, score int"
PAGES = "page_id long, url string, html string, payload int"


def brute_top(rows, k, scale, is_query):
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q and len(a) == len(b))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(seed, n, spread):
    rng = random.Random(seed)
    return [(i, [rng.randint(-spread, spread) / 4 for _ in range(3)], 0) for i in range(n)]


@pytest.mark.parametrize("seed,n,spread", [(1, 300, 40), (2, 300, 1), (3, 4, 4)])
def test_top_k_equals_brute_force(spark, seed, n, spread):
    """A spread of 1 makes nearly every score a tie; 4 rows are fewer than k + 1."""
    rows = vectors(seed, n, spread)
    got = K.top_k(spark.createDataFrame(rows, VECTORS).repartition(5), F.col("vec_id") % 3 == 0, k=5, scale=256)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 5, 256, lambda q: q % 3 == 0)


def test_top_k_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 7)
    rows = vectors(5, 120, 6)
    got = K.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 4 == 0, k=3)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 3, 256, lambda q: q % 4 == 0)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (5, [None, 1.0], 0), (None, [9.0, 9.0], 0), (6, [1.0, 1.0], 0), (7, [1.0, 1.0, 1.0], 0)]
    got = K.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 2 == 0)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 5, 256, lambda q: q % 2 == 0)
    assert K.top_k(spark.createDataFrame([], VECTORS), F.lit(True)).collect() == []


def brute_warc(rows, least):
    payloads = [(i, (h or "").encode()) for i, _, h, _ in rows]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= least:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, p in payloads:
        keep = first.get(p)
        revisit = i is not None and keep is not None and keep != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def pages():
    rng = random.Random(2)
    rows = [(i, rng.choice([f"http://a.b/{i}", "http://ü.b/\r\nX: y", None]), rng.choice(["<p>a</p>", "<p>é\r\n\r\n</p>", "WARC/1.1\r\n\r\n", None, "", str(i)]), 0) for i in range(60)]
    return rows + [(3, "http://a.b/again", rows[3][2], 0), (None, "http://a.b/null", "only", 0), (99, "http://a.b/long", "long " * 600_000, 0)]


@pytest.mark.parametrize("least,size", [(0, W.ARCHIVE_BYTES), (5, 200)])
def test_round_trip(spark, least, size):
    rows = pages()
    got = W.round_trip(spark.createDataFrame(rows, PAGES).repartition(3), least, size)
    found = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute_warc(rows, least)
    text = {(i, (h or "").encode()) for i, _, h, _ in rows}
    assert all((r.page_id, bytes(r.payload)) in text for r in found if r.record_type == "response")
    assert W.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_records_of_any_members_and_chunks():
    whole = [W.record(1, "http://x", b"a\r\n\r\nb", None), W.record(2, None, b"", None), W.record(3, "http://y", b"zz", 1)]
    data = gzip.compress(whole[0] + whole[1][:9]) + gzip.compress(whole[1][9:]) + gzip.compress(b"") + gzip.compress(whole[2])
    for size in (1, 7, 1 << 20):
        assert [x for _, x in W.records(W.inflated(io.BytesIO(data), size))] == whole
    with pytest.raises(ValueError):
        list(W.records(iter([whole[0][:-3]])))


def test_each_record_is_a_member(spark, tmp_path):
    source = tmp_path / "one.warc.gz"
    source.write_bytes(gzip.compress(W.record(1, "http://x", b"abc", None) + W.record(2, "http://y", b"", None)))
    folder = f"file://{tmp_path}/out"
    listed = W.normalise(spark.createDataFrame([(str(source),)], "archive string"), folder)
    path = listed.collect()[0].archive
    index = spark.read.schema(W.INDEX).json(path.replace(".warc.gz", ".index.json")).orderBy("offset").collect()
    data = open(path, "rb").read()
    assert [(r.id, r.uri) for r in index] == [("<urn:page:1>", "http://x"), ("<urn:page:2>", "http://y")]
    assert [gzip.decompress(data[r.offset : r.offset + r.length]) for r in index] == [W.record(1, "http://x", b"abc", None), W.record(2, "http://y", b"", None)]
    assert sum(r.length for r in index) == len(data)


def test_top_k_of_large_components(spark):
    """Components of any size: exact while a score fits in 64 bits, else the nearest value that does."""
    rng = random.Random(9)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.choice([0.25, 1e3, 1e7, 3e9, 1e15]) * rng.randint(1, 9) for _ in range(2)], 0) for i in range(80)]
    rows = [(i, [float(x) for x in __import__("numpy").float32(v)], s) for i, v, s in rows]
    most = (1 << 63) - 1
    wanted = []
    scale = lambda v: [math.floor(256 * x) for x in v]
    for q, a, _ in rows[::4]:
        scored = sorted((-max(-most, min(most, sum(x * y for x, y in zip(scale(a), scale(b), strict=True)))), i) for i, b, _ in rows if i != q)
        wanted += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:5])]
    got = K.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 4 == 0, k=5, scale=256)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == sorted(wanted)


@pytest.mark.parametrize("lost", [1, 8, 9, 200])
def test_a_cut_off_archive_raises(lost):
    """Also where it ends at a record's edge, before the stream's end mark."""
    whole = b"".join(W.record(i, None, b"x" * 50, None) for i in range(20))
    assert b"".join(W.inflated(io.BytesIO(gzip.compress(whole) * 2), 64)) == whole * 2
    with pytest.raises(ValueError, match="end mark"):
        list(W.records(W.inflated(io.BytesIO(gzip.compress(whole)[:-lost]), 64)))


def test_inflated_chunks_are_bounded():
    whole = b"0" * 5_000_000
    chunks = list(W.inflated(io.BytesIO(gzip.compress(whole)), 4096))
    assert max(map(len, chunks)) <= 4096 and b"".join(chunks) == whole and list(W.inflated(io.BytesIO(b""))) == []


def test_round_trip_without_payloads(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, None, None)], "page_id long, url string, html string")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    with_them, without = (W.round_trip(pages, payloads=x).collect() for x in (True, False))
    assert sorted(map(str, (r[n] for r in with_them for n in names))) == sorted(map(str, (r[n] for r in without for n in names)))
    assert all(r.payload is None for r in without) and {r.page_id: r.payload for r in with_them} == {1: b"a", 2: None, 3: b""}
