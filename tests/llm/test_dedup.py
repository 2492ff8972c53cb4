import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.llm import membership
from pagewright.llm import near_dedup as near_dedup_module
from pagewright.llm.base import cut
from pagewright.llm.components import connected_components
from pagewright.llm.exact_dedup import exact_dedup
from pagewright.llm.membership import filter_bits, split
from pagewright.llm.near_dedup import near_dedup, needed

DOCS = "doc_id long, text string, n long, h string"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def brute_exact(rows, pick):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, pick(groups[t or ""]), len(groups[t or ""]), i == pick(groups[t or ""])) for i, t in rows)


@pytest.mark.parametrize("keep,pick", [("min", min), ("max", max)])
@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, keep, pick, weak):
    texts = ["a", "b", "a", None, "", "c" * 50_000, "c" * 50_000, "é", "a", "d", "e"]
    more = {"hash_of": lambda t: F.substring(F.md5(t), 1, 1)} if weak else {}
    got = exact_dedup(docs(spark, texts), keep=keep, **more).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == brute_exact(list(enumerate(texts)), pick)
    assert {r["text_sha256"] for r in got if r["doc_id"] in (3, 4)} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}


def test_exact_forced_collision(spark):
    got = exact_dedup(docs(spark, ["a", "b", "a", "b", "c"]), hash_of=lambda t: F.lit("same")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(0, 0, 2), (1, 1, 2), (2, 0, 2), (3, 1, 2), (4, 4, 1)]


def test_exact_edges(spark):
    assert exact_dedup(docs(spark, ["a"]).limit(0)).count() == 0
    got = exact_dedup(docs(spark, ["a", "a", "a"], [7, 7, None])).collect()
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(7, 3)] * 3 and sum(r["kept"] for r in got) == 2


def shingle_set(text, width):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute_near(texts, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def corpus(seed, n=160):
    """Loose copies of a few texts, a passage that most share, short texts, and copies."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz") + str(rng.randrange(40))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([12, 40, 90, 200]))] for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.6:
            own = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
        elif kind < 0.8:
            own = [word() for _ in range(rng.choice([5, 30, 120]))]
            own[3:3] = passage
            out.append("\n".join(own).title())
        else:
            out.append(rng.choice([None, "", "  ", "One", "one two", "ONE two ", "one two three four", word()]))
    return out


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 80), (2, 5, 80), (3, 4, 60)])
def test_near_equals_brute_force(spark, seed, width, percent):
    texts = corpus(seed)
    got = near_dedup(docs(spark, texts), width=width, percent=percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_near(texts, width, percent)


def test_near_edges(spark):
    assert near_dedup(docs(spark, ["a"]).limit(0)).count() == 0
    got = near_dedup(docs(spark, ["a b c", "A  b\tc", "a b c"], [5, 3, None])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("3", 3, True), ("5", 3, False), ("None", 3, False)]
    long = "word " * 200_000
    assert near_dedup(docs(spark, [long, long + "end"])).select("component_id").distinct().count() == 2


def test_near_repeated_and_null_ids(spark):
    """Rows of one id share its component, and a set's own text is what is compared, whichever row of its id comes first."""
    rng = random.Random(5)
    t, u, other = (" ".join(f"w{rng.getrandbits(40)}" for _ in range(60)) for _ in range(3))
    rows = [(1, t), (5, t), (5, u), (7, u + " more"), (8, other), (8, None), (9, None), (None, other + " end"), (2, "alone"), (None, "nobody")]
    got = near_dedup(docs(spark, [x for _, x in rows], [i for i, _ in rows])).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=key)
    expected = [(1, 56, 1, True), (5, 56, 1, False), (5, 56, 1, False), (7, 57, 1, False), (8, 56, 8, True), (8, 0, 8, True), (9, 0, 9, True)]
    expected += [(None, 57, 8, False), (2, 1, 2, True), (None, 1, None, False)]
    assert found == sorted(expected, key=key)



def test_near_hashed_rows_are_linked_by_text_alone(spark):
    got = near_dedup(docs(spark, ["a b c d e f", "a b c d e f", "u v w x y z"], [1, 5, 5]), hashed=True).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (5, 1, False), (5, 5, True)]


def test_near_deals_long_lists(spark, monkeypatch):
    monkeypatch.setattr(near_dedup_module, "MEMBERS", 3)
    monkeypatch.setattr(near_dedup_module, "PAIRS", 4)
    texts = corpus(6)
    got = near_dedup(docs(spark, texts), width=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == brute_near(texts, 4, 80)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="the test tables aren't here")
def test_near_equals_brute_force_on_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())
    ids = [i for i, _ in rows]
    expected = [(ids[i], n, ids[c], kept) for i, n, c, kept in brute_near([t for _, t in rows], 4, 80)]
    got = near_dedup(table, width=4).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == expected


def test_filter_grows_with_keys_and_memory():
    gb = 1 << 30
    assert filter_bits(0, gb) == 1 << 16 and filter_bits(10_000_000, gb) == 1 << 27
    assert filter_bits(10_000_000, 64 * gb) >= 32 * 10_000_000 and filter_bits(10**10, 1000 * gb) == 1 << 32


@pytest.mark.parametrize("most,passing", [(1 << 32, 600), (1 << 16, 50_000)])
def test_filter_loses_no_key(spark, monkeypatch, most, passing):
    """All rows with a key pass, few others while the keys fit, more of them beyond the bound; null keys are keys."""
    monkeypatch.setattr(membership, "MOST_BITS", most)
    rows = spark.range(60_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").alias("__held_by"))
    keys = cut(rows.where("k is null or k % 6 = 0").select("k"), "keys")
    without, maybe = split(rows, ["k"], keys)
    assert maybe.where("k is null or k % 6 = 0").count() == 10_000 and without.count() + maybe.count() == 60_000
    assert maybe.count() - 10_000 < passing and maybe.columns == ["k", "__held_by"]


def test_texts_are_filtered_before_they_are_joined(spark, monkeypatch):
    """No semi-join on the way of the texts, as Spark pushes it below the filter of keys and then shuffles all of them."""
    rows = docs(spark, corpus(7, 20)).select("doc_id", "text").withColumn("text_hash", F.xxhash64("text")).withColumn("row", near_dedup_module._row())
    pairs = rows.where("doc_id < 5").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.col("row").alias("ra"), F.col("row").alias("rb"))
    seen = []
    with_both = near_dedup_module._with_both
    monkeypatch.setattr(near_dedup_module, "_with_both", lambda p, a, b: seen.append(a[1]) or with_both(p, a, b))
    near_dedup_module._verified(cut(pairs, "pairs"), rows, 4, 80)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "__held" in plan and "LeftSemi" not in plan


def test_needed_is_a_tail_bound():
    assert 20 < needed(48, 80) < 30 and needed(48, 100) == 48


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_near_links_sets_little_larger_than_the_sketch(spark):
    """Pairs at the threshold or just above it, the smaller set inside the larger: each pair is one component."""
    rng = random.Random(4)
    texts = []
    for small, large in [(80, 100), (72, 90), (64, 80), (52, 65), (104, 130), (80, 97)] * 150:
        own = [f"w{rng.getrandbits(60)}" for _ in range(large + 3)]
        texts += [" ".join(own), " ".join(own[: small + 3])]
    got = near_dedup(docs(spark, texts), width=4, percent=80).collect()
    assert [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 2 * 2] == []
