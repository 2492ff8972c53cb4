"""Pages that are odd, deep or hostile; addresses and references; policies as data."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright import api
from pagewright.functions import dom as D
from pagewright.functions import guards as G
from pagewright.functions import resolution as R
from pagewright.functions import styles
from pagewright.plans.markup_queries import LAYOUTS, STYLES

PAGES = "page_id long, url string, html string"


def markdown(html):
    return "\n\n".join(x if isinstance(x, str) else x["markdown"] for x in D.content(D.parse(html)))


@pytest.mark.parametrize(
    "html,wanted",
    [
        ("<blockquote><blockquote><p>deep</p></blockquote>out</blockquote>", "> > deep\n>\n> out"),
        ("<blockquote>plain <b>bold</b></blockquote>", "> plain **bold**"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n> b"),
        ("<blockquote>a<ul><li>b</li></ul></blockquote>", "> a\n>\n> - b"),
        ("<ul><li>a<div><ul><li>b</li></ul></div>c</li></ul>", "- a\n  - b\n  c"),
        ("<ol><li>a<ol><li>b</li></ol></li><li>c</li></ol>", "1. a\n   1. b\n2. c"),
        ("<ul><li><p>a</p><p>b</p></li></ul>", "- a b"),
        ("<ul><li>a</li><ul><li>b</li></ul>stray</ul>", "- a\n  - b\n- stray"),
        ("<ul><li><ul><li>b</li></ul></li><li></li></ul>", "-\n  - b\n-"),
        ("<ul><li>a<pre>x\ny</pre></li></ul>", "- a\n  ```\n  x\n  y\n  ```"),
        ("<div>bare <b>bold <b>twice</b></b><p>p</p>after <a href='/x'>l</a></div>", "bare **bold twice**\n\np\n\nafter [l](/x)"),
        ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", "| a b |"),
    ],
)
def test_nested_blocks(html, wanted):
    assert markdown(html) == wanted


@pytest.mark.parametrize("tag", ["<ul><li>", "<blockquote>", "<ol><li><blockquote><ul><li>", "<div>", "<b>", "<table><tr><td>"])
def test_depth_has_no_bound(tag):
    """No block is lost and nothing recurses, however deep a page is."""
    root = D.parse("<body><p>first</p>" + f"{tag}x" * 3000)
    found = markdown("<p>first</p>" + f"{tag}x" * 3000)
    assert found.count("x") == 3000 and "first" in found
    assert D.main_content(root).text().count("x") == 3000


def test_unwrapping_many_siblings():
    root = D.parse("<div>" + "<x>a<y>b</y></x>" * 20_000 + "</div>")
    assert D.apply_rules(root, allowed_tags=("div",)) == 40_000
    assert root.text("") == "ab" * 20_000 and all(n.tag in ("", "div") for n in root.nodes())


def test_one_page_does_not_end_the_job(spark):
    deep = '<script type="application/ld+json">' + "[" * 100_000 + "]" * 100_000 + "</script>"
    heads = [
        '<link rel="canonical" href="http://[x"><meta property="og:url" content="/og">',
        '<script type="application/ld+json">{"author": 7, "datePublished": [{"name": null}, "2020"]}</script>',
        deep + '<meta name="author" content="A">',
        '<base href="https://b.org/d/"><link rel="canonical" href="x">',
        '<link rel="canonical" href="ftp://a.org/x"><link rel="canonical" href="../y#z">',
        '<base href="javascript:x"><link rel="canonical" href="?q">',
    ]
    pages = spark.createDataFrame([(i, "https://a.org/p/q", f"<html><head>{h}</head><body></body></html>") for i, h in enumerate(heads)] + [(9, None, None)], PAGES)
    rows = {r["page_id"]: r for r in api.metadata(pages).collect()}
    assert [rows[i]["canonical_url"] for i in (0, 3, 4, 5)] == ["https://a.org/og", "https://b.org/d/x", "https://a.org/y#z", "https://a.org/p/q?q"]
    assert (rows[1]["author"], rows[1]["published"], rows[2]["author"]) == ("7", "2020", "A")
    assert all(r["error"] is None for r in rows.values()) and rows[9]["canonical_url"] is None


def test_links_follow_the_base(spark):
    article = "<article><p>Words enough for the article to be the content of the page, and more.</p>{}</article>"
    links = '<a href="x">1</a><a href="//cdn.org/y">2</a><a href="../z">3</a><a href="#t">4</a><a href="mailto:a@b">5</a><a href=" x ">6</a><a href="http://[bad">7</a>'
    pages = spark.createDataFrame([(i, "https://a.org/p/q", f"<html><head>{h}</head><body>{article.format(links)}</body></html>") for i, h in enumerate(["", '<base href="https://b.org/d/">'])], PAGES)
    plain, based = api.ingest(pages).orderBy("page_id").collect()
    assert plain["internal"] == ["https://a.org/p/x", "https://a.org/z"] and plain["external"] == ["https://cdn.org/y"] and plain["anchors"] == ["#t"]
    assert based["internal"] == [] and based["external"] == ["https://b.org/d/x", "https://cdn.org/y", "https://b.org/z"]


def resolve(spark, base, references):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(references)], "i int, x string")
    return [r["y"] for r in rows.select("i", R.resolved(R.parts(F.lit(base)), F.col("x")).alias("y")).orderBy("i").collect()]


# The examples of RFC 3986, 5.4, without those in which a scheme of its own has no authority.
RFC = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s",
    "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g",
    "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.", ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g",
    "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/./x": "http://a/b/c/g?y/./x", "g#s/../x": "http://a/b/c/g#s/../x",
}


def test_resolution_of_the_standard(spark):
    assert dict(zip(RFC, resolve(spark, "http://a/b/c/d;p?q", list(RFC)), strict=True)) == RFC
    assert resolve(spark, "http://a", ["g", "?q", "", "#f"]) == ["http://a/g", "http://a?q", "http://a", "http://a#f"]


def folded(path):
    """Dot segments removed character by character, as RFC 3986, 5.2.4 says it."""
    out = ""
    while path:
        if path.startswith("../"):
            path = path[3:]
        elif path.startswith("./") or path.startswith("/./"):
            path = path[2:]
        elif path == "/.":
            path = "/"
        elif path.startswith("/../") or path == "/..":
            path, out = "/" + path[4:], out[: out.rfind("/")] if "/" in out else ""
        elif path in (".", ".."):
            path = ""
        else:
            end = path.find("/", 1)
            end = len(path) if end < 0 else end
            out, path = out + path[:end], path[end:]
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("ab./.;", max_size=9), min_size=80, max_size=80))
def test_dot_segments(spark, paths):
    some = [x for x in paths if x and not x.startswith("//")]
    wanted = ["http://h" + folded(x if x.startswith("/") else "/x/y/" + x) for x in some]
    assert resolve(spark, "http://h/x/y/z?q", some) == wanted


def test_policies_as_data(spark):
    page = "<html><body><article><p>Words enough for the article to be the content of the page, and more.</p><table><tr><td>c</td></tr></table></article></body></html>"
    hosts = ["a.org", "x.a.org", "b.org", "c.org", "d.org"]
    pages = spark.createDataFrame([(i, f"https://{h}/", page) for i, h in enumerate(hosts)] + [(7, None, page)], PAGES)
    policies = [
        {"domain": "x.a.org", "blocked_tags": ["TABLE"], "policy_name": "paranoid", "notes": "first"},
        {"domain": "a.org", "include_subdomains": True, "block_threshold": 0},
        {"domain": "c.org", "allowed_tags": ["p", "article"], "strict": True},
        {"domain": "d.org", "block_threshold": 0.2, "warn_threshold": 0.9},
    ]
    docs = api.ingest_by_domain(pages, policies)
    rows = {r["page_id"]: r for r in docs.collect()}
    assert [rows[i]["domain"] for i in (0, 1, 2, 3, 4, 7)] == ["a.org", "x.a.org", None, "c.org", "d.org", None]
    assert ["| c |" in rows[i]["markdown"] for i in (0, 1, 2, 3)] == [True, False, True, False]
    assert [rows[i]["policy_action"] for i in (0, 1, 2)] == ["block", "allow", "allow"] and rows[1]["notes"] == "first"
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [run(") == 1
    for bad in ({"domain": "a", "colour": 1}, {"domain": "a", "policy_name": "none"}):
        with pytest.raises(ValueError):
            api.ingest_by_domain(pages, [bad])
    many = spark.range(2000).select(F.col("id").cast("int").alias("priority"), F.concat(F.lit("h"), "id", F.lit(".org")).alias("domain"), F.lit(True).alias("include_subdomains"), F.array(F.lit("table")).alias("blocked_tags"))
    more = spark.createDataFrame([(i, f"https://www.h{i * 400}.org/", page) for i in range(6)], PAGES)
    got = api.ingest_by_domain(more, many).orderBy("page_id").collect()
    assert [r["domain"] for r in got] == [f"h{i * 400}.org" for i in range(5)] + [None] and ["|" in r["markdown"] for r in got] == [False] * 5 + [True]


@pytest.mark.parametrize("style,hidden", STYLES)
def test_styles(style, hidden):
    assert styles.hides(style) is hidden


def test_declarations():
    assert list(styles.declarations("a:1;B : url(x;y) !IMPORTANT; c: 'q;\\'' ;d;:e; f:g(1;2")) == [("a", "1", False), ("b", "url(x;y)", True), ("c", "'q;\\''", False), ("f", "g(1;2)", False)]
    assert styles.number("calc(2 * 3px + 1px)") == (7.0, "px") and styles.number("calc(1px + 1em)") is None and styles.number("calc(1px / 0)") is None and styles.number("auto") is None
    assert styles.number("-1.5e2%") == (-150.0, "%")


@settings(max_examples=300, deadline=None)
@given(st.text("a:;()'\"\\/*! -0px,", max_size=40))
def test_styles_of_any_text(style):
    assert styles.hides(style) in (True, False)


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_main_content_by_brute_force(layout):
    """All sentences of the article stay, wherever the layout puts them, and nothing else does."""
    parts = [f"<p>Part {i} of the article, which is long enough to be seen as a paragraph, has commas.</p>" for i in range(12)]
    before, between, after = LAYOUTS[layout].split("@")
    text = D.main_content(D.parse(f"<html><body>{before}{''.join(parts[:7])}{between}{''.join(parts[7:])}{after}</body></html>")).text()
    assert all(f"Part {i} of" in text for i in range(12)) and "Menu entry" not in text and "comment" not in text and "sidebar" not in text


@pytest.mark.parametrize("pattern,unsafe", [("(a+b)*", True), (r"(\w+\s?)*", True), ("(a|b|ab)*c", True), ("(?:x{1,5}){30}", True), ("(foo|bar)*baz", False), ("[a-z]+[0-9]+", False), ("", False), (r"ign(?:ore|oring) (?:all |any )?previous", False), ("(x*)*", True), ("a(?=(b+)+)", True)])
def test_backtracking_of_parsed_expressions(pattern, unsafe):
    assert G.may_backtrack(pattern) is unsafe


def test_reports_of_odd_pages_are_json(spark):
    pages = spark.createDataFrame([(1, "https://a.org/", "<ul><li>" * 2000 + "x"), (2, "https://a.org/", "<![CDATA[<p>x"), (3, "", "<a href='퟿'>y"), (4, None, "<p>" + "long " * 50_000)], PAGES)
    rows = api.security_report(api.ingest(pages)).collect()
    assert len(rows) == 4 and all(json.loads(r["report_json"])["risk_level"] == "safe" for r in rows)
