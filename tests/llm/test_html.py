"""Main text by site style trees: pages made from known articles and known boilerplate."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import pytest

from pagewright.llm import html_extraction as H

PAGES = "page_id long, url string, html string, text int"


def article(rng):
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8)))
    return [" ".join(word() for _ in range(rng.randint(4, 25))).capitalize() + "." for _ in range(rng.randint(2, 6))]


def page(blocks, skin="a"):
    body = "".join(f"<p>{x}</p>\n" for x in blocks)
    if skin == "a":
        return (
            "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='<p>no</p>';</script></head><body>"
            "<nav><ul><li><a href='/'>Home</a><li><a href='/x'>About us</a></ul></nav>"
            f"<article><h1>{blocks[0]}</h1>{body}</article>"
            "<div class='promo'>Buy our things today</div><div id=comments><p>first!</p></div><footer>All rights reserved</footer></body></html>"
        )
    return f"<html><body><div class=top>Welcome to the site</div><div class=text><h2>{blocks[0]}</h2>{body}</div><div class=low>Contact and imprint</div></body></html>"


def corpus():
    rng = random.Random(8)
    rows = []
    for i in range(60):
        own, skin = article(rng), "ab"[i % 2]
        rows.append((i, f"https://{skin}.example.org/{i}", own, page(own, skin)))
    return rows


def test_articles_of_two_sites(spark):
    """Site b's boilerplate has no telling names: only the tree shows that every page repeats it."""
    rows = corpus()
    got = {r.page_id: r for r in H.extract(spark.createDataFrame([(i, u, h, 0) for i, u, _, h in rows], PAGES).repartition(3)).collect()}
    for i, url, own, _ in rows:
        assert got[i].text == "\n\n".join([own[0], *own]) and got[i].n_chars == len(got[i].text) and got[i].url == url


@pytest.mark.parametrize(
    "html,wanted",
    [
        ("<p>a &amp; b&nbsp;&#233;\n  c<p>d<b>e</b>f<br>g", ["a & b é c", "def g"]),
        ("x<!-- y -->z<script>if (a</p>b) {}</script>w", ["xzw"]),
        ("<div>a</span></p><p>b</div>c", ["a", "b", "c"]),
        ("<textarea><p>no</textarea><form><p>no</p></form>yes", ["yes"]),
        ("1 < 2 <p title='a>b'>t</p>", ["1 < 2", "t"]),
        ("", []),
        ("<p>", []),
    ],
)
def test_blocks_of_a_page(html, wanted):
    assert [b.text for b in H.parse(html)[0]] == wanted


def test_edges(spark):
    rows = [(1, None, None, 0), (2, "", "", 0), (3, "nonsense", "<p>lonely text</p>", 0), (3, "nonsense", "<p>lonely text</p>", 0), (None, "http://h/", "<p>" + "long " * 200_000, 0), (4, "http://h/", "<div>" * 3000 + "deep", 0)]
    got = H.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((str(r.page_id), r.text[:11], r.n_chars) for r in got) == sorted(
        [("1", "", 0), ("2", "", 0), ("3", "lonely text", 11), ("3", "lonely text", 11), ("None", "long long l", 999_999), ("4", "deep", 4)]
    )
    assert H.extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("unique", [0, 5, 12])
def test_copies_of_a_page_are_one_page(spark, unique):
    """20 copies of a page, alone and with unique pages of the host; and 20 copies over as many hosts."""
    rng = random.Random(unique)
    copied, other = article(rng), [article(rng) for _ in range(unique)]
    rows = [(i, "https://c.example.org/x", page(copied), copied) for i in range(20)]
    rows += [(20 + i, f"https://c.example.org/{i}", page(own), own) for i, own in enumerate(other)]
    rows += [(40 + i, f"https://{i}.example.net/", page(copied, "b"), copied) for i in range(20)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(i, u, h, 0) for i, u, h, _ in rows], PAGES).repartition(3)).collect()}
    for i, _, _, own in rows:
        assert "\n\n".join([own[0], *own]) in got[i]


@pytest.mark.parametrize(
    "opening,closing",
    [
        ("<body class='has-sidebar'>", "</body>"),
        ("<body class=widget><div>", "</div></body>"),
        ("<div class='content with-sidebar'>", "</div>"),
        ("<div id=ad-free-article>", "</div>"),
        ("<main class=widget>", "</main>"),
        ("<article class='post comment'>", "</article>"),
        ("<div class=widget>", "</div>"),  # named, but every page differs in text and build
    ],
)
def test_the_tree_decides_about_named_branches(spark, opening, closing):
    """A telling word in a class doesn't cost the article or its title; named branches that repeat go."""
    rng, rows = random.Random(3), []
    for i in range(12):
        own = article(rng)
        body = "".join(rng.choice(["<p>{}</p>", "<h3>{}</h3>", "<p>{}</p><hr>"]).format(x) for x in own)
        rows.append((i, f"https://n.example.org/{i}", own, f"<html>{opening}<h1 class='entry-header'>{own[0]}</h1>{body}{closing}<div class='ad'>{' '.join(article(rng))}</div><nav><p>Home</p></nav>"))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(i, u, h, 0) for i, u, _, h in rows], PAGES)).collect()}
    for i, _, own, _ in rows:
        assert got[i] == "\n\n".join([own[0], *own])


HIDDEN = "form button select object svg canvas template audio video textarea title script style noscript iframe".split()


@pytest.mark.parametrize("tag", HIDDEN)
@pytest.mark.parametrize(
    "html,wanted",
    [
        ("<body><{0}>no<p>yes</p><div>too</div></body>", ["yes", "too"]),
        ("<body><div><{0}>no</div><p>yes</p>", ["yes"]),
        ("<ul><li><{0}>no</li><li>yes</ul>too", ["yes", "too"]),
        ("<p>yes</p><{0}>no</{0}>too<{0}/><p>and</p>", ["yes", "too", "and"]),
    ],
)
def test_unclosed_hidden_elements(tag, html, wanted):
    assert [b.text for b in H.parse(html.format(tag))[0]] == wanted


@pytest.mark.parametrize(
    "html,wanted",
    [
        ("<html><head><title>t</title><body><p>article", ["article"]),
        ("<html><head><title>t</title><meta name=a><script>'<p>no</p>'</script><p>article", ["article"]),
        ("<html><head><title>t<body><p>article", ["article"]),
        ("<body><form>no<p>yes</p><form>no<p>no</p></form>too", ["yes", "too"]),
        ("<div><form><div>no</div><p>no</form>yes</div>", ["yes"]),
        ("<div><form>no</div><p>yes</p><form>no</form><button><div>no</div></button>", ["yes"]),
        ("<div><svg><svg>no</svg>no</svg>yes</div>", ["yes"]),
        ("<ul><li><form><ul><li>no<li>no</ul></li><li>yes</ul></form>", ["yes"]),
    ],
)
def test_ends_of_hidden_elements(html, wanted):
    assert [b.text for b in H.parse(html)[0]] == wanted


def entropy(counts, m):
    return -sum(n / m * math.log(n / m, m) for n in counts) if m > 1 else 1.0


def brute_trees(pages):
    """(site, node) -> (pages, importance), in plain dicts; pages: distinct (site, html)."""
    built, held, styles = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for site, html in pages:
        blocks, own = H.parse(html)
        for node, children in own.items():
            built[site, node].add(html)
            styles[site, node][" | ".join(sorted(children))] += 1
        for node, parent, text in {(b.node, b.parent, b.text) for b in blocks}:
            held[site, node, parent][text] += 1
    out = {}
    for (site, node, parent), texts in held.items():
        m = len(built[site, node])
        whole = sum(texts.values())
        content = 1 - sum(n * math.log(n, m) for n in texts.values()) / whole if m > 1 else 1.0
        out[site, node] = m, (content + entropy(styles[site, parent].values(), len(built[site, parent]))) / 2
    return out


def brute_text(rows):
    own, every = brute_trees({(u, h) for _, u, h in rows}), brute_trees({("", h) for _, _, h in rows})
    out = {}
    for i, site, html in rows:
        kept = []
        for b in H.parse(html)[0]:
            (m, value), (m_all, of_all) = own[site, b.node], every["", b.node]
            weight, prior = m - 1, H.PRIOR * (m_all > 1)
            if not (b.named if weight + prior == 0 else (weight * value + prior * of_all) / (weight + prior) * (H.NAMED if b.named else 1) < H.THRESHOLD):
                kept.append(b.text)
        out[i] = "\n\n".join(kept)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_trees_against_brute_force(spark, seed, monkeypatch):
    """Sites of one to thirty pages, of two skins and of pages of no skin, some pages copied; joins of both kinds."""
    monkeypatch.setattr(H, "BROADCAST_KEYS", seed % 2 * H.BROADCAST_KEYS)
    rng, rows = random.Random(seed), []
    for s, size in enumerate([1, 2, 3, 5, 7, 8, 9, 30]):
        for _ in range(size):
            own = article(rng)
            html = rng.choice([page(own, "ab"[s % 2])] * 4 + ["".join(f"<{t}>{x}</{t}>" for x in own for t in [rng.choice(["p", "h2", "aside", "div class=menu"])])])
            rows += [(len(rows) + c, f"https://s{s}.example.org/", html) for c in range(rng.choice([1, 1, 1, 4]))]
    wanted = brute_text(rows)
    got = H.extract(spark.createDataFrame([(*r, 0) for r in rows], PAGES).repartition(5)).collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == wanted


@pytest.mark.parametrize("size", [3, 5, 7, 8, 20])
def test_a_small_site_uses_its_own_tree(spark, size):
    """Its boilerplate has no telling names, and repeats on no other site."""
    rng = random.Random(size)
    rows = [(i, f"https://b.example.org/{i}", article(rng)) for i in range(size)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(i, u, page(x, "b"), 0) for i, u, x in rows], PAGES)).collect()}
    assert got == {i: "\n\n".join([x[0], *x]) for i, _, x in rows}


def test_classes_that_number_pages_do_not_split_nodes(spark):
    """Body and article are numbered on every page; the repeated block has no telling name, and goes."""
    rng = random.Random(9)
    rows = []
    for i in range(20):
        own = article(rng)
        body = "".join(f"<p>{x}</p>" for x in own)
        html = f'<html class="v{i} day"><body class="post postid-{i} word{"abcdefghijklmnopqrst"[i]}"><div class=low>Contact and imprint</div><article id="post-{i}"><div class=text>{body}</div></article></body></html>'
        rows.append((i, f"https://c.example.org/{i}", own, html))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame([(i, u, h, 0) for i, u, _, h in rows], PAGES)).collect()}
    assert got == {i: "\n\n".join(own) for i, _, own, _ in rows}


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "deep", "<div class='a b'>" * 30_000 + "deep" + "</div></p></nav>" * 30_000, "<svg>" + "<div>" * 50_000 + "</p>" * 50_000 + "</svg>deep"])
def test_deep_pages(html):
    """Time and memory follow the number of elements, not their depth."""
    tracemalloc.start()
    blocks, styles = H.parse(html)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [b.text for b in blocks] == ["deep"] and len(styles) in (1, 30_001, 100_001) and peak < 200 << 20


def test_deep_page_through_spark(spark):
    rows = [(1, "https://d.example.org/1", "<div>" * 30_000 + "deep", 0), (2, "https://d.example.org/2", "<p>flat</p>", 0)]
    assert {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()} == {1: "deep", 2: "flat"}
