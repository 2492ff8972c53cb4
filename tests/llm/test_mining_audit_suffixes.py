"""Hard negatives, the filter audit and suffix dedup against brute force, and their edges."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import filter_audit as A
from pagewright.llm import hard_negatives as H
from pagewright.llm import suffix_dedup as S

VECTORS = "vec_id long, embedding array<double>, label int, v int"
MOST = (1 << 63) - 1


def clipped(x):
    return max(-MOST - 1, min(MOST, x))


def brute_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95):
    fine = [(i, [clipped(math.floor(256 * x)) for x in v], lab) for i, v, lab, _ in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _, _ in fine if anchor(i)}:
        _, a, own = min((i, v, lab) for i, v, lab in fine if i == q)
        scored = sorted((-max(-MOST, min(MOST, sum(x * y for x, y in zip(a, v, strict=True)))), i, lab) for i, v, lab in fine if i != q and len(v) == len(a))
        for p, (s, i, _) in enumerate([x for x in scored if x[2] == own][:positives]):
            found = [(-n, j) for n, j, lab in scored if lab != own and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(q, i, r + 1, j, -s, n, p + 1) for r, (n, j) in enumerate(found)]
    return sorted(out)


def mined(spark, rows, anchor, **more):
    got = H.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5), anchor, **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect())


def vectors(seed, n, size, spread, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.randint(-spread, spread) / 4 for _ in range(size)], rng.randrange(labels), 0) for i in range(n)]


@pytest.mark.parametrize("seed,n,size,spread,labels", [(1, 400, 16, 40, 3), (2, 300, 3, 1, 2), (3, 5, 4, 4, 2), (4, 200, 9, 10, 1)])
def test_hard_negatives(spark, seed, n, size, spread, labels):
    """A spread of 1 makes nearly every score a tie; one label leaves no negatives."""
    rows = vectors(seed, n, size, spread, labels)
    found = mined(spark, rows, F.col("vec_id") % 3 == 0)
    assert found == brute_negatives(rows, lambda i: i % 3 == 0)
    assert bool(found) == (labels > 1 and n > 5)


def test_hard_negatives_in_chunks_and_blocks(spark, monkeypatch):
    for name, value in (("CHUNK_BYTES", 9000), ("BLOCK", 7), ("ANCHORS", 5), ("PAIRS", 4), ("DENSE", 2.0)):
        monkeypatch.setattr(H, name, value)
    rows = vectors(5, 150, 8, 12)
    assert mined(spark, rows, F.col("vec_id") % 4 == 0) == brute_negatives(rows, lambda i: i % 4 == 0)


def test_hard_negatives_edges(spark):
    rows = vectors(6, 40, 2, 6, 2) + [(41, None, 1, 0), (42, [], 1, 0), (43, [float("nan"), 1.0], 0, 0), (44, [float("inf"), 1.0], 0, 0), (45, [None, 1.0], 0, 0), (46, [1.0, 1.0], None, 0)]
    rows += [(None, [9.0, 9.0], 0, 0), (47, [1.0, 1.0, 1.0], 0, 0), (48, [1.0, 1.0, 2.0], 1, 0), (8, [3.0, 1.0], 1, 0), (8, [3.0, 1.0], 1, 0), (9, [2.0, 1.0], 0, 0)]
    assert mined(spark, rows, F.col("vec_id") % 2 == 0) == brute_negatives(rows, lambda i: i % 2 == 0)
    assert mined(spark, rows[:0], F.lit(True)) == [] and mined(spark, rows, F.lit(False)) == []


@pytest.mark.parametrize("factor", [1e7, 1e12, 1e30])
def test_hard_negatives_of_large_components(spark, factor):
    rows = [(i, [x * factor for x in v], lab, 0) for i, v, lab, _ in vectors(7, 60, 3, 5, 2)]
    assert mined(spark, rows, F.col("vec_id") % 5 == 0) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_rotation_is_orthogonal_and_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (200, 12))
    q = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    y, rest = H._turned(x, q)
    begin = 0
    total = np.zeros((200, 200))
    for stage, end in enumerate(H._parts(12)):
        total += y[:, begin:end] @ y[:, begin:end].T
        assert (np.abs(x @ x.T - total) <= np.outer(rest[:, stage], rest[:, stage]) + 1e-6).all()
        begin = end


DOCS = "doc_id long, text string, source string, quality int"
LABELS = "doc_id long, quality int, toxic int"


def brute_audit(rows, labels):
    first = {}
    for i, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = []
    for i, t, source, _ in rows:
        t = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = ("A" * (len(words) < 50)) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and t in first and first[t] < i)
        docs.append((source or "", set(fails), i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                fail, here = [d for d in own if x in d[1]], [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                gone[x] += len(here)
                out[part, "".join(order), step + 1] = [len(left), len(here), len(fail) - len(here), sum(d[1] == {x} for d in own), sum(d[2] for d in here), sum(d[3] for d in here)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(gone[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def audited(spark, rows, labels):
    got = A.audit(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS), A.text_filters(), copies="E")
    return sorted(tuple(r) for r in got.select("part", "filter_order", "step", *A._COUNTS, "shapley").collect())


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "d", "é", "五", "#", "&x", "e\x0bf"]
    made = [" ".join(rng.choices(words[: rng.randint(2, 9)], k=rng.choice([3, 49, 50, 51, 90]))) for _ in range(n)]
    return [rng.choice(made) for _ in range(n)]


def test_audit(spark, monkeypatch):
    monkeypatch.setattr(A, "ROWS", 20)
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["a", "b", None, "c"]), 0) for i, t in enumerate(corpus(4, 150))]
    rows += [(None, rows[3][1], "a", 0), (None, None, "a", 0), (200, None, "b", 0), (201, "", "b", 0), (202, "", None, 0), (5, rows[5][1], "a", 0), (203, "word " * 100_000, "long", 0), (204, "Unique text", "lone", 0)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(3, 0, 0), (3, 1, 0), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_without_rows_labels_or_copies(spark):
    assert audited(spark, [], []) == []
    rows = [(i, t, "a", 0) for i, t in enumerate(corpus(5, 20))]
    assert audited(spark, rows, []) == brute_audit(rows, [])
    got = A.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS), {"x": F.length("text") > 100}).collect()
    assert [(r["filter_order"], r["step"], r["kept"], r["shapley"]) for r in got] == [("x", 1, sum(len(t) <= 100 for _, t, _, _ in rows), sum(len(t) > 100 for _, t, _, _ in rows))]
    with pytest.raises(ValueError):
        A.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS), {"long": F.lit(True)})


def test_copies_of_hot_texts_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(A, "LEAST_HOT", 3)
    rows = [(i, f"text {i % 7}" if i % 2 else f"lone {i}", "a", 0) for i in range(60)]
    assert audited(spark, rows, []) == brute_audit(rows, [])


TEXTS = "doc_id long, text string, spans int"


def brute_suffixes(rows, width):
    seen = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - width + 1):
                w = b[k : k + width]
                seen[w] = min(i, seen.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - width + 1):
                if seen[b[k : k + width]] < i:
                    gone[k : k + width] = b"\x01" * width
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((-1 if i is None else i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def without(spark, rows, width=50):
    got = S.without_repeats(spark.createDataFrame([(i, t, 0) for i, t in rows], TEXTS).repartition(3), width).collect()
    for r in got:
        assert sum(s["length"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got)


def passages(seed, n, letters="abcdefgh é五"):
    """Texts of random letters that share passages of 40 to 120 characters, at any offset, and whole copies."""
    rng = random.Random(seed)
    shared = ["".join(rng.choices(letters, k=rng.randint(40, 120))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice([rng.choice(shared), rng.choice(shared)[rng.randint(0, 9) :], "".join(rng.choices(letters, k=rng.randint(0, 30)))]) for _ in range(rng.randint(0, 8))]
        out.append("".join(parts))
    return out + [rng.choice(out) for _ in range(n // 3)]


@pytest.mark.parametrize("seed,letters,width", [(1, "abcdefgh é五", 50), (2, "ab", 50), (3, "a", 50), (4, "abc", 32), (5, "abcd ", 77)])
def test_suffixes(spark, monkeypatch, seed, letters, width):
    """Few letters make periodic texts, in which windows of one bucket and one document repeat."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 4000)
    rows = list(enumerate(passages(seed, 60, letters)))
    assert without(spark, rows, width) == brute_suffixes(rows, width)


def test_suffixes_in_small_blocks_and_slices(spark, monkeypatch):
    for name, value in (("BLOCK_BYTES", 300), ("SLICE", 64), ("BUCKET_BYTES", 3000)):
        monkeypatch.setattr(S, name, value)
    rows = list(enumerate(passages(6, 40)))
    random.Random(1).shuffle(rows)
    assert without(spark, rows) == brute_suffixes(rows, 50)


def test_suffixes_edges(spark):
    text = "0123456789" * 4 + "abcdefghij"
    rows = [(5, text), (5, text), (3, text[:49]), (9, None), (None, text), (None, None), (7, ""), (8, "x" + text + "y" + text), (10, "é" + text[1:] + "é"), (-4, "z" * 200), (11, "z" * 51), (12, "q" * 500_000), (13, "q" * 50)]
    assert without(spark, rows) == brute_suffixes(rows, 50)
    assert without(spark, []) == []
    with pytest.raises(ValueError):
        S.without_repeats(spark.createDataFrame([], TEXTS), 20)


def test_ties_are_settled_by_bytes_not_by_fingerprints(monkeypatch):
    """With fingerprints that are all equal, ranks of the cover alone tell the windows apart."""
    monkeypatch.setattr(S, "mix64", lambda x: x * np.uint64(0))
    texts = [t.encode() for t in passages(8, 12, "ab") if len(t.encode()) >= 50]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    got = S.repeated_windows(raw, np.cumsum(size) - size, size - 49, np.arange(len(texts)), 50)
    first = {}
    windows = [(i, t[k : k + 50]) for i, t in enumerate(texts) for k in range(len(t) - 49)]
    for i, w in windows:
        first.setdefault(w, i)
    assert got.tolist() == [first[w] < i for i, w in windows]


def test_cover_has_all_differences():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))
