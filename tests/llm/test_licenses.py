"""Licence scans against a plain TF-IDF over dictionaries and a plain walk up the directories."""

import math
import random
import re
from collections import Counter

import pytest

from pagewright.llm import licenses as L

SCHEMA = "doc_id long, text string, path string, score string"


def plain_words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_best(texts, unit):
    """(name, cosine) of the best template for one unit of text, weights by all ``texts``."""
    vocabulary = {w for _, t in L.TEMPLATES for w in plain_words(t)}
    df = Counter(w for t in texts for w in set(plain_words(t)) & vocabulary)
    idf = {w: math.log((1 + len(texts)) / (1 + df[w])) + 1 for w in vocabulary}
    other = max(idf.values())
    found = Counter(plain_words(unit))
    norm = math.sqrt(sum((n * idf[w]) ** 2 if w in idf else n * other**2 for w, n in found.items()))
    best = (None, 0.0)
    for name, template in L.TEMPLATES:
        own = {w: n * idf[w] for w, n in Counter(plain_words(template)).items()}
        dot = sum(n * idf[w] * own[w] for w, n in found.items() if w in own)
        cosine = round(dot / norm / math.sqrt(sum(x * x for x in own.values())), 12) if norm else 0.0
        if cosine > best[1]:
            best = (name, cosine)
    return best


def plain_units(text):
    lines = (text or "").split("\n")
    paragraphs, held = [], []
    for line in [*lines, ""]:
        if plain_words(line):
            held.append(line)
        elif held:
            paragraphs.append(" ".join(held))
            held = []
    return lines + paragraphs


def corpus():
    rng = random.Random(3)
    prose = "river stone the of under version work table licence garden public general window and".split()
    rows = []
    for i in range(80):
        lines = [" ".join(rng.choices(prose, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 5))]
        if i % 3 == 0:
            notice = rng.choice(L.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                notice[rng.randrange(len(notice))] = rng.choice(prose)
            if i % 2:  # over two lines
                notice.insert(len(notice) // 2, "\n")
            lines.insert(rng.randint(0, len(lines)), " ".join(notice))
            lines.insert(0, "")
        rows.append((i, "\n".join(lines), f"d{i % 4}/{i}.txt", "x"))
    return rows


def test_headers_equal_plain_cosines(spark):
    rows = corpus()
    texts = [r[1] for r in rows]
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    hits = 0
    for i, text, _, _ in rows:
        wanted = [x for x in (plain_best(texts, u) for u in plain_units(text)) if x[1] >= L.THRESHOLD]
        assert got[i].licenses == sorted({name for name, _ in wanted})
        if wanted:
            hits += 1
            assert got[i].origin == "header" and got[i].score == pytest.approx(max(c for _, c in wanted), abs=1e-9)
            assert got[i].license in {n for n, c in wanted if c == pytest.approx(got[i].score, abs=1e-9)}
        else:
            assert got[i].origin != "header" or plain_best(texts, text)[1] >= L.THRESHOLD
    assert hits > 15


def test_the_nearest_directory_gives_its_licence(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, mit, "LICENSE", "a"),
        (2, apache + "\n\n" + "some more words that are not in a template at all " * 5, "a/b/LICENSE.txt", "a"),
        (3, "prose", "a/b/c/d/file.py", "a"),
        (4, "prose", "a/file.py", None),
        (5, "Licensed under CC BY-NC 4.0.\nprose", "a/b/own.py", "a"),
        (6, "prose", None, "a"),
        (7, None, "a/b/empty.py", "a"),
        (8, "prose", "a/bb/file.py", "a"),
        (8, "prose", "a/bb/file.py", "a"),
        (None, "", "a/b/c/null-id.py", "a"),
    ]
    got = [(r.doc_id, r.license, r.origin, r.from_path) for r in L.scan(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "MIT", "header", None),
            (2, "Apache-2.0", "header", None),
            (3, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
            (4, "MIT", "inherited", "LICENSE"),
            (5, "CC-BY-NC-4.0", "header", None),
            (6, None, None, None),
            (7, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
            (8, "MIT", "inherited", "LICENSE"),
            (8, "MIT", "inherited", "LICENSE"),
            (None, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
        ],
        key=str,
    )


def test_an_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []
