import random

import numpy as np
import pyarrow as pa
import pytest

from pagewright.llm import language_id as L
from pagewright.llm import toxicity as T
from pagewright.llm.base import text_blocks
from pagewright.llm.words import shingles, words
from tests.llm.test_dedup import shingle_set

SYLLABLES = {"aa": "ka mi no te ru so".split(), "bb": "schl ung ich ein ver ß".split(), "cc": "eau oi ç é que an".split()}


def text(rng, lang, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(5)
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES))), lang, i) for i in range(n)]


def test_grams_are_spans_of_characters():
    (lo, hi, raw, at), = text_blocks(pa.array(["aé", "", None, "b"]))
    counts = [len(b) for _, b in L.grams(raw, at)]
    assert (lo, hi) == (0, 4) and counts == [3, 1, 0]


def test_language_held_out(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, score long")
    model = L.learn(L.labelled_rows(docs))
    assert model.languages == ["aa", "bb", "cc"]
    got = L.identify(docs, model, keep=("lang",)).where("lang_pred = lang and score > 0.5").count()
    assert got == 240


def test_language_equals_plain_bayes(spark):
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    model = L.learn(docs.selectExpr("doc_id id", "text", "lang label"))
    counts = {k: np.full(L.BUCKETS, L.SMOOTHING) for k in SYLLABLES}
    for _, t, lang, _ in rows:
        for _, _, raw, at in text_blocks(pa.array([t])):
            for _, bucket in L.grams(raw, at):
                np.add.at(counts[lang], bucket, 1)
    for i, lang in enumerate(model.languages):
        assert np.allclose(model.log_prob[:, i], np.log(counts[lang] / counts[lang].sum()), atol=1e-5)


def test_language_edges(spark):
    rows = [(0, None, "aa"), (1, "", "aa"), (2, "12 !?", "aa"), (3, "kamino", None), (None, "kamino", "aa"), (4, "kamino " * 300_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learn(L.labelled_rows(docs, held_out=9))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(docs, model).collect()}
    assert got == {0: ("und", 0.0), 1: ("und", 0.0), 2: ("und", 0.0), 3: ("aa", 1.0), None: ("aa", 1.0), 4: ("aa", 1.0)}
    nothing = L.learn(L.labelled_rows(docs).limit(0))
    assert {r["lang_pred"] for r in L.identify(docs, nothing).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def toxic_corpus(n=900):
    rng = random.Random(7)
    out = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        own = text(rng, rng.choice(list(SYLLABLES)), rng.randint(5, 200)).split()
        for _ in range(3 * label):
            own.insert(rng.randrange(len(own) + 1), rng.choice(["vile", "Nasty.", "GRIM"]))
        out.append((i, " ".join(own), label))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(3, None, 0)], "doc_id long, toxic int, text int")
    got = {r["doc_id"]: r for r in T.toxicity(docs, T.learn(T.labelled_rows(docs, labels))).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p for y, p in held if y]) > 0.95 and np.mean([p for y, p in held if not y]) < 0.02


def test_ftrl_equals_a_plain_loop():
    """Coordinate by coordinate, in plain Python, after the published update; every feature takes part, rare ones too."""
    rng, rows = random.Random(3), []
    for _ in range(160):
        y = int(rng.random() < 0.4)
        rows.append((sorted({rng.randrange(40) for _ in range(6)} | ({50 + rng.randrange(3)} if y else set())), y))
    z, n, sums = {}, {}, []

    def weight(i, l1):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((T.BETA + ni**0.5) / T.ALPHA + T.L2)

    for _ in range(T.EPOCHS):
        for x, y in rows:
            w = {i: weight(i, T.L1) for i in x} | {-1: weight(-1, 0.0)}
            sums.append(sum(w.values()))
            g = (1 / (1 + np.exp(-max(-35, min(35, sums[-1])))) - y) * (T.POSITIVE if y else 1.0)
            for i in w:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / T.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    wanted = {i: weight(i, T.L1) for i in z if i >= 0 and weight(i, T.L1)}
    bias, bucket, w = T.ftrl([np.array(x) for x, _ in rows], np.array([y for _, y in rows]))
    assert 0 < len(wanted) < len(z) and bucket.tolist() == sorted(wanted)
    assert bias == pytest.approx(weight(-1, 0.0)) and w.tolist() == pytest.approx([wanted[i] for i in sorted(wanted)])


def test_toxicity_score_is_the_sum_of_distinct_features():
    (_, _, raw, at), = text_blocks(pa.array(["vile Vile, x"]))
    buckets = np.unique(np.concatenate([b for _, b in T.features(raw, at)]))
    weight = np.zeros(T.BUCKETS, np.float32)
    weight[buckets] = 0.25
    assert T.score(0.0, weight, pa.array(["vile Vile, x"]))[0] == pytest.approx(1 / (1 + np.exp(-0.25 * len(buckets))))


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (None, "x"), (1, "long " * 300_000)], "doc_id long, text string")
    none = T.learn(T.labelled_rows(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert [(r["score"], r["predicted"]) for r in T.toxicity(docs, none).collect()] == [(0.5, 0)] * 4
    assert T.toxicity(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("width", [1, 2, 4, 6])
def test_shingles_count_as_brute_force(width):
    rng = random.Random(width)
    texts = [" ".join(rng.choices(["a", "B", "b", "é", "\t", "x y"], k=rng.randint(0, 12))) for _ in range(200)] + ["", None]
    for lo, hi, raw, at in text_blocks(pa.array(texts), limit=64):
        flat, first = shingles(words(raw, at), width)
        for r in range(hi - lo):
            assert len(np.unique(flat[first[r] : first[r + 1]])) == len(shingle_set(texts[lo + r], width))
