"""URL, host, link and resource queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import addresses as A
from pagewright.functions import dom as D
from pagewright.functions import fixed as V
from pagewright.functions import resolution as R
from pagewright.functions import resources as Z
from pagewright.functions import urls as U
from pagewright.operators.policies import first_policy
from pagewright.plans.augment import read

HOST_SQL = "regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':[0-9]*$', ''), '[.]+$', '')"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


def _varied(pages: DataFrame) -> DataFrame:
    """Pages with ports, fragments, tracking and file names that the table's own URLs lack, by page_id."""
    url = F.col("url")
    url = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(url, r"^https?://([^/?#]*)", "HTTP://$1:80")).otherwise(url)
    url = F.when((F.col("page_id") % 7 == 0) & ~F.contains(url, F.lit("?")) & ~F.contains(url, F.lit("#")), F.concat(url, F.lit("?utm_source=x&a=1&fbclid=2"))).otherwise(url)
    return pages.select("page_id", url.alias("url"))


_VARIED_SQL = """
    v0 AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(url, '^https?://([^/?#]*)', 'HTTP://\\1:80') ELSE url END AS url FROM pages),
    v AS (SELECT page_id, CASE WHEN page_id % 7 = 0 AND NOT contains(url, '?') AND NOT contains(url, '#') THEN url || '?utm_source=x&a=1&fbclid=2' ELSE url END AS url FROM v0)"""


def url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(read(spark, sf_dir, "pages")).select("page_id", U.identity(F.col("url")).alias("identity"))


def tracking_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _varied(read(spark, sf_dir, "pages")).select("page_id", U.without_tracking(F.col("url")).alias("url"))


def url_nonhtml_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.element_at(F.array(*[F.lit(x) for x in ("/report.PDF", "/login/x", "/a.html", "/accounts", "/data.json")]), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.concat(F.regexp_extract("url", r"^([^?#]*?)/?(?:[?#]|$)", 1), ends)
    return read(spark, sf_dir, "pages").select("page_id", U.is_non_html(url).alias("is_non_html"), U.is_auth_page(url).alias("is_auth"))


def _requested(pages: DataFrame) -> DataFrame:
    hosts = ["localhost", "10.1.2.3", "metadata.google.internal", "8.8.8.8", "192.168.0.1", "127.0.0.1", "172.31.255.255", "172.32.0.1", "100.64.1.1", "1.1.1.1"]
    own = F.element_at(F.array(*[F.lit(x) for x in hosts]), (F.col("page_id") % 10 + 1).cast("int"))
    return pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://"), own, F.lit("/x"))).when(F.col("page_id") % 31 == 0, F.lit("ftp://h/x")).otherwise(F.col("url")).alias("url"))


_REQUESTED_SQL = """
    q AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://' || ['localhost', '10.1.2.3', 'metadata.google.internal', '8.8.8.8', '192.168.0.1', '127.0.0.1', '172.31.255.255', '172.32.0.1', '100.64.1.1', '1.1.1.1'][page_id % 10 + 1] || '/x'
          WHEN page_id % 31 = 0 THEN 'ftp://h/x' ELSE url END AS url FROM pages)"""


def ssrf_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requested(read(spark, sf_dir, "pages")).select("page_id", A.fetch_refusal(F.col("url")).alias("refusal"))


def cidr_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x, *U.range_bounds(x)) for x in V.BLOCKED_RANGES], "cidr string, lo long, hi long")


def cidr_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with the range that holds them; the ranges are a constant table, broadcast."""
    rows = _requested(read(spark, sf_dir, "pages")).select("page_id", U.ipv4_value(U.host(F.col("url"))).alias("ip")).where("ip is not null")
    ranges = F.broadcast(cidr_ranges(spark))
    return rows.join(ranges, (rows["ip"] >= ranges["lo"]) & (rows["ip"] <= ranges["hi"])).select("page_id", "ip", "cidr")


#: Ranges that overlap, touch and hold one another.
_WATCHED = ("10.0.0.0/8", "10.1.0.0/16", "11.0.0.0/8", "128.0.0.0/2", "200.7.0.0/16", "fd00::/9", "fd40::/10", "2001:db8::/32", "fe80::/10")


def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of both kinds in eight forms: their digits, the watched range that holds them, whether they are internal."""
    n = (F.col("event_id") * 2654435761) % (1 << 32)
    octets = [F.shiftright(n, s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0)]
    dotted = F.concat_ws(".", *(o.cast("string") for o in octets))
    groups = F.concat_ws(":", F.lower(F.hex(F.shiftright(n, 16))), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))
    forms = [
        dotted, F.concat(F.lit("::ffff:"), dotted), F.concat(F.lit("[::FFFF:"), groups, F.lit("]")), F.concat_ws(".", *(F.concat(F.lit("0"), F.conv(o, 10, 8)) for o in octets)),
        F.concat_ws(".", *(F.concat(F.lit("0x"), F.lower(F.hex(o))) for o in octets)), F.concat_ws(".", octets[0].cast("string"), octets[1].cast("string"), n.bitwiseAND(F.lit(65535)).cast("string")),
        F.concat(F.element_at(F.array(*map(F.lit, ("fd7f", "fd80", "2001:db8", "2606:4700", "fe80"))), (n % 5 + 1).cast("int")), F.lit("::"), groups, F.lit("%eth0")), F.concat(dotted, F.lit(".1")),
    ]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 8 + 1).cast("int"))
    rows = A.held(read(spark, sf_dir, "events").select("event_id", text.alias("text")), "address", A.address(F.col("text")))
    ranges = spark.createDataFrame([A.cidr_bounds(x) for x in _WATCHED], "lo string, hi string")
    return A.in_ranges(rows, ranges).select("event_id", "address", "range_lo", A.is_internal(F.col("address")).alias("internal"))


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [(0, "blog.tionble.example.com", False, "strict", 0.5), (1, "example.org", True, "paranoid", 0.3), (2, "example.com", True, "normal", 0.7), (3, "tionsh.example.net", False, "permissive", 0.9), (4, "example.net", True, "normal", None)]
    return spark.createDataFrame(rows, "priority int, domain string, include_subdomains boolean, policy_name string, block_threshold double")


def domain_policy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    return first_policy(pages, policy_table(spark)).select("page_id", "domain", "policy_name")


def resource_block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = ["www.google-analytics.com/ga.js", "cdn.hotjar.com/x", "static.example.com/app.js", "ads.example.com/a", "example.com/pixel/1", "www.facebook.com/tr", "example.com/loads/1", "x.criteo.com/b"]
    kinds = ["script", "image", "font", "xhr", "media"]
    pages = read(spark, sf_dir, "pages")
    url = F.concat(F.lit("https://"), F.element_at(F.array(*[F.lit(x) for x in hosts]), (F.col("page_id") % 8 + 1).cast("int")))
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("page_id") % 5 + 1).cast("int"))
    rows = pages.select(kind.alias("resource_type"), Z.decision(kind, url).alias("x"))
    return rows.groupBy("resource_type", F.col("x.matched").alias("matched")).agg(F.count("*").alias("requests"), F.count_if("x.blocked").alias("blocked"))


def resource_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources of pages, one of each reason, of which most have several: the first in order counts."""
    urls = ["ftp://ads.example.com/a", "https://hotjar.com/a", "https://x.own.example/pixel/1", "https://www.hotjar.com/a", "https://ads.example.com/a", "http://[::ffff:10.0.0.1]/x", "data:text/plain,x", "https://example.com/a"]
    url = F.element_at(F.array(*map(F.lit, urls)), (F.col("page_id") % 8 + 1).cast("int"))
    kind = F.when(F.col("page_id") % 8 == 1, "image").otherwise("script")
    rows = read(spark, sf_dir, "pages").select("page_id", Z.decision(kind, url, custom=("OWN.example.",)).alias("x"))
    return rows.select("page_id", "x.blocked", "x.matched", "x.reason")


def page_title_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    lang = F.lower(F.regexp_extract("html", r'(?i)<html[^>]*\blang="([^"]*)"', 1))
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.split(F.split(lang, ",")[0], "-")[0].alias("lang"))


def _links(pages: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", "url", F.posexplode(found).alias("position", "href")).where("trim(href) <> ''")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, resolved against the page, with their kind."""
    rows = _links(read(spark, sf_dir, "pages"))
    rows = R.held(rows, "target", R.resolved(R.parts(F.col("url")), F.col("href")))
    return rows.select("page_id", F.col("position").cast("bigint").alias("position"), "target", R.link_kind(F.col("href"), F.col("target"), U.host(F.col("url"))).alias("kind"))


#: References of each form that RFC 3986 has, and some that browsers accept.
_REFERENCES = (
    "x", "../x", "./a/../b", "a/./b/", "..", ".", "?q=1", "", "#top", "/abs/./y/..", "//cdn.org/x/../y", "https://other.org/a/../b?c#d", "../../../../up/", "g;x=1/../y", "HTTPS:rel", "  sp\tace  ",
    "mailto:a@b.org", "javascript:void(0)", "?q=../x#../y", "a//b/../c", "tel:1", "ftp://f.org/x", "/", "g?y/./x",
)
_BASES = ("", "https://b.org/d/e", "sub/", "../up?z", "ftp://no.org/", "//c.org")


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with a base of one of six forms, and references of all forms: what they mean, and their kind."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^([A-Za-z]+://[^/?#]*)", 1), F.lit("/d/e/f?q")).alias("url"))
    declared = F.element_at(F.array(*map(F.lit, _BASES)), (F.col("page_id") % len(_BASES) + 1).cast("int"))
    rows = pages.select("page_id", "url", R.effective_base(F.col("url"), declared).alias("base")).select("page_id", "url", R.parts(F.col("base")).alias("base"), F.posexplode(F.array(*map(F.lit, _REFERENCES))).alias("form", "href"))
    rows = R.held(rows, "target", R.resolved(F.col("base"), F.col("href")))
    return rows.select("page_id", F.col("form").cast("bigint").alias("form"), "target", R.link_kind(F.col("href"), F.col("target"), U.host(F.col("url"))).alias("kind"))


def links_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, each once a page, by the host that they lead to; anchors don't count."""
    rows = page_links(spark, sf_dir).where("kind in ('internal', 'external')").select("page_id", "target").distinct()
    return rows.groupBy(U.host(F.col("target")).alias("host")).agg(F.count("*").alias("links"), F.countDistinct("page_id").alias("pages"))


def removed_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = D.UNWANTED
    counted = F.array(*[F.struct(F.lit(t).alias("tag"), F.regexp_count("html", F.lit(f"(?i)<{t}[ >]")).alias("n")) for t in tags])
    rows = read(spark, sf_dir, "pages").select(F.explode(counted).alias("x")).where("x.n > 0")
    return rows.groupBy(F.col("x.tag").alias("tag")).agg(F.count("*").alias("pages"), F.sum("x.n").cast("bigint").alias("elements"))


def meta_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    charset = F.regexp_extract("html", r'(?i)<meta\s+charset="([^"]*)"', 1)
    return read(spark, sf_dir, "pages").select("page_id", F.nullif(charset, F.lit("")).alias("charset"), F.regexp_count("html", F.lit(r"(?i)<meta\b")).cast("bigint").alias("metas"))


def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page's html against those of its text without tags, and the share saved."""
    bare = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    rows = read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_count("html", F.lit(r"[A-Za-z0-9_]+")).cast("bigint").alias("html_tokens"), F.regexp_count(bare, F.lit(r"[A-Za-z0-9_]+")).cast("bigint").alias("text_tokens")
    )
    saved = F.greatest(F.col("html_tokens") - F.col("text_tokens"), F.lit(0))
    share = F.when(F.col("html_tokens") > 0, F.floor(saved * 10000 / F.col("html_tokens"))).otherwise(F.lit(0))
    return rows.select("*", saved.alias("saved"), share.cast("bigint").alias("saved_basis_points"))


def host_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in an order that takes one of each host in turn; hosts in order of their first page."""
    rows = read(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"))
    own = Window.partitionBy("host")
    ranked = rows.withColumn("turn", F.row_number().over(own.orderBy("page_id")).cast("bigint")).withColumn("host_first", F.min("page_id").over(own))
    return ranked.select("page_id", "host", "turn", "host_first")


def host_soft_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 of that order (a limit that the operator has)."""
    return host_round_robin(spark, sf_dir).orderBy("turn", "host_first").limit(100).select("page_id", "host")


def unique_urls_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_extract("url", r"^([^?#]*)", 1)
    host = F.concat(U.scheme(bare), F.lit("://"), U.host(bare), F.concat(F.lit("/"), (F.col("page_id") % 10).cast("string")))
    return read(spark, sf_dir, "pages").select("page_id", host.alias("url")).groupBy("url").agg(F.min("page_id").alias("first_page_id"), F.count("*").alias("seen"))


def url_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requested(read(spark, sf_dir, "pages"))
    reason = F.when(~U.scheme(F.col("url")).isin("http", "https"), "unsupported scheme").when(U.host(F.col("url")) == "", "no host").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("urls"))


def _split_sql(q: str) -> str:
    return f"list_filter(string_split({q}, '&'), lambda p: NOT list_contains({V.TRACKING_PARAMETERS!r}, lower(string_split(p, '=')[1])))"


_RANGES = ", ".join(f"('{x}', {U.range_bounds(x)[0]}, {U.range_bounds(x)[1]})" for x in V.BLOCKED_RANGES)
_IP = "CAST(string_split(h, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(h, '.')[2] AS BIGINT) * 65536 + CAST(string_split(h, '.')[3] AS BIGINT) * 256 + CAST(string_split(h, '.')[4] AS BIGINT)"
_IS_IP = "regexp_matches(h, '^[0-9]+([.][0-9]+){3}$')"
_TAGS = D.UNWANTED
# The table's references are absolute, begin with / or #, or are relative without dots.
_LINKS_SQL = f"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS f FROM pages), e AS (SELECT page_id, url AS page_url, unnest(f) AS href, generate_subscripts(f, 1) - 1 AS position FROM l),
    t AS (SELECT *, regexp_extract(page_url, '^([A-Za-z]+:)', 1) AS scheme, regexp_extract(page_url, '^([A-Za-z]+://[^/?#]*)', 1) AS origin, regexp_extract(page_url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM e WHERE trim(href) <> ''),
    u AS (SELECT page_id, position, href, page_url, CASE WHEN regexp_matches(href, '^[A-Za-z]+:') THEN href WHEN starts_with(href, '//') THEN scheme || href WHEN starts_with(href, '/') THEN origin || href
        WHEN starts_with(href, '#') THEN regexp_replace(page_url, '#.*$', '') || href ELSE origin || regexp_extract(path || '/', '^(/.*/|/)', 1) || href END AS target FROM t),
    k AS (SELECT page_id, position, target, CASE WHEN starts_with(href, '#') THEN 'anchor' WHEN NOT regexp_matches(lower(target), '^https?://.') THEN NULL
        WHEN {HOST_SQL.replace('url', 'target')} = {HOST_SQL.replace('url', 'page_url')} THEN 'internal' ELSE 'external' END AS kind FROM u)"""

QUERIES = {
    f.__name__: f
    for f in (
        url_identity, tracking_params, url_nonhtml_auth, ssrf_check, cidr_range_join, address_ranges, domain_policy_join, resource_block_stats, resource_decisions, page_title_lang, page_links, resolved_links,
        links_by_domain, removed_tag_counts, meta_regex, token_savings, host_round_robin, host_soft_cap, unique_urls_first_seen, url_drop_reasons,
    )
}

ORACLE_SQL = {
    "url_identity": f"WITH {_VARIED_SQL} SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || {HOST_SQL} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END AS identity FROM v",
    "tracking_params": f"WITH {_VARIED_SQL}, s AS (SELECT page_id, url, {_split_sql(_QUERY)} AS kept, len(string_split({_QUERY}, '&')) AS n FROM v) SELECT page_id, CASE WHEN len(kept) = n THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END || regexp_extract(url, '(#.*)$', 1) END AS url FROM s",
    "url_nonhtml_auth": "SELECT page_id, page_id % 5 IN (0, 4) AS is_non_html, page_id % 5 IN (1, 3) AS is_auth FROM pages",
    "ssrf_check": f"WITH {_REQUESTED_SQL}, h AS (SELECT page_id, url, {HOST_SQL} AS h FROM q) SELECT page_id, CASE WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'scheme' WHEN h IN ('localhost', 'metadata.google.internal') THEN 'blocked host' WHEN {_IS_IP} AND EXISTS (SELECT 1 FROM (VALUES {_RANGES}) AS r(c, lo, hi) WHERE CASE WHEN {_IS_IP} THEN {_IP} END BETWEEN lo AND hi) THEN 'blocked address' END AS refusal FROM h",
    "cidr_range_join": f"WITH {_REQUESTED_SQL}, h AS (SELECT page_id, {HOST_SQL} AS h FROM q), i AS (SELECT page_id, {_IP} AS ip FROM h WHERE {_IS_IP}) SELECT page_id, ip, cidr FROM i JOIN (VALUES {_RANGES}) AS r(cidr, lo, hi) ON ip BETWEEN lo AND hi",
    "address_ranges": """WITH n AS (SELECT event_id, event_id % 8 AS form, event_id * 2654435761 % 4294967296 AS n FROM events), a AS (SELECT event_id, form, n, n % 5 AS k, CASE WHEN form < 6 THEN repeat('0', 20) || 'ffff' || printf('%08x', n)
        WHEN form = 6 THEN ['fd7f0000', 'fd800000', '20010db8', '26064700', 'fe800000'][n % 5 + 1] || repeat('0', 16) || printf('%08x', n) END AS address FROM n)
        SELECT event_id, address, CASE WHEN form < 6 THEN repeat('0', 20) || 'ffff' || CASE WHEN n >> 24 IN (10, 11) OR n >> 30 = 2 THEN printf('%02x000000', n >> 24) WHEN n >> 16 = 51207 THEN 'c8070000' END
            WHEN form = 6 THEN CASE k WHEN 0 THEN 'fd7f' || repeat('0', 28) WHEN 2 THEN '20010db8' || repeat('0', 24) WHEN 4 THEN 'fe80' || repeat('0', 28) END END AS range_lo,
            CASE WHEN form = 6 THEN k <> 3 WHEN form < 6 THEN n >> 24 IN (0, 10, 127) OR n >> 24 >= 224 OR n >> 22 = 401 OR n >> 16 = 43518 OR n >> 20 = 2753 OR n >> 16 = 49320 OR n >> 17 = 25353 OR n >> 8 IN (12582912, 12582914, 12989284, 13303921) END AS internal FROM a""",
    "domain_policy_join": f"""WITH p AS (SELECT * FROM (VALUES (0, 'blog.tionble.example.com', false, 'strict'), (1, 'example.org', true, 'paranoid'), (2, 'example.com', true, 'normal'), (3, 'tionsh.example.net', false, 'permissive'), (4, 'example.net', true, 'normal')) AS t(priority, domain, sub, policy_name)),
        h AS (SELECT page_id, {HOST_SQL} AS h FROM pages), m AS (SELECT page_id, domain, policy_name, row_number() OVER (PARTITION BY page_id ORDER BY priority) AS k FROM h LEFT JOIN p ON h = domain OR sub AND ends_with(h, '.' || domain))
        SELECT page_id, domain, policy_name FROM m WHERE k = 1""",
    "resource_block_stats": """WITH r AS (SELECT ['script', 'image', 'font', 'xhr', 'media'][page_id % 5 + 1] AS resource_type,
        ['google-analytics.com', 'hotjar.com', NULL, 'ads.', '/pixel/', 'facebook.com/tr', NULL, 'criteo.com'][page_id % 8 + 1] AS m FROM pages)
        SELECT resource_type, CASE WHEN resource_type IN ('image', 'font', 'media') THEN NULL ELSE m END AS matched, count(*) AS requests, count(*) FILTER (WHERE resource_type IN ('image', 'font', 'media') OR m IS NOT NULL) AS blocked FROM r GROUP BY ALL""",
    "resource_decisions": """SELECT page_id, page_id % 8 < 6 AS blocked, [NULL, NULL, 'own.example', 'hotjar.com', 'ads.', NULL, NULL, NULL][page_id % 8 + 1] AS matched,
        ['scheme', 'kind', 'custom', 'tracker', 'advert', 'address', NULL, NULL][page_id % 8 + 1] AS reason FROM pages""",
    "page_title_lang": "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, string_split(string_split(lower(regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1)), ',')[1], '-')[1] AS lang FROM pages",
    "page_links": _LINKS_SQL + " SELECT page_id, position, target, kind FROM k",
    "links_by_domain": _LINKS_SQL + f" SELECT {HOST_SQL.replace('url', 'target')} AS host, count(DISTINCT page_id || ' ' || target) AS links, count(DISTINCT page_id) AS pages FROM k WHERE kind IN ('internal', 'external') GROUP BY 1",
    "resolved_links": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_extract(url, '^[A-Za-z]+:(//[^/?#]*)', 1) AS a FROM pages),
        b AS (SELECT page_id, s AS ps, a AS pa, CASE WHEN page_id % 6 = 1 THEN 'https' ELSE s END AS s, CASE page_id % 6 WHEN 1 THEN '//b.org' WHEN 5 THEN '//c.org' ELSE a END AS a,
            ['/d/e/', '/d/', '/d/e/sub/', '/d/', '/d/e/', '/'][page_id % 6 + 1] AS folder, ['/d/', '/', '/d/e/', '/', '/d/', '/'][page_id % 6 + 1] AS above,
            ['/d/e/f', '/d/e', '/d/e/sub/', '/d/up', '/d/e/f', ''][page_id % 6 + 1] AS path, ['?q', '', '', '?z', '?q', ''][page_id % 6 + 1] AS query FROM p),
        t AS (SELECT *, s || ':' || a AS o FROM b),
        r AS (SELECT page_id, ps, pa, [o || folder || 'x', o || above || 'x', o || folder || 'b', o || folder || 'a/b/', o || above, o || folder, o || path || '?q=1', o || path || query, o || path || query || '#top', o || '/abs/',
            s || '://cdn.org/y', 'https://other.org/b?c#d', o || '/up/', o || folder || 'y', CASE WHEN s = 'https' THEN o || folder || 'rel' ELSE 'https:rel' END, o || folder || 'space', 'mailto:a@b.org', 'javascript:void(0)',
            o || path || '?q=../x#../y', o || folder || 'a//c', 'tel:1', 'ftp://f.org/x', o || '/', o || folder || 'g?y/./x'] AS targets FROM t),
        e AS (SELECT page_id, ps, pa, unnest(targets) AS target, generate_subscripts(targets, 1) - 1 AS form FROM r)
        SELECT page_id, form, target, CASE WHEN form = 8 THEN 'anchor' WHEN form IN (7, 16, 17, 20, 21) OR target = 'https:rel' THEN NULL
            WHEN lower(regexp_replace(regexp_extract(target, '^[a-z]+://([^/?#]*)', 1), ':[0-9]*$', '')) = lower(regexp_replace(pa[3:], ':[0-9]*$', '')) THEN 'internal' ELSE 'external' END AS kind FROM e""",
    "removed_tag_counts": "SELECT tag, count(*) AS pages, CAST(sum(n) AS BIGINT) AS elements FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS tag, len(regexp_extract_all(html, '(?i)<{t}[ >]')) AS n FROM pages" for t in _TAGS) + ") WHERE n > 0 GROUP BY tag",
    "meta_regex": "SELECT page_id, nullif(regexp_extract(html, '(?i)<meta\\s+charset=\"([^\"]*)\"', 1), '') AS charset, len(regexp_extract_all(html, '(?i)<meta\\b')) AS metas FROM pages",
    "token_savings": "WITH t AS (SELECT page_id, len(regexp_extract_all(html, '[A-Za-z0-9_]+')) AS html_tokens, len(regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'), '[A-Za-z0-9_]+')) AS text_tokens FROM pages) SELECT page_id, html_tokens, text_tokens, greatest(html_tokens - text_tokens, 0) AS saved, CASE WHEN html_tokens > 0 THEN greatest(html_tokens - text_tokens, 0) * 10000 // html_tokens ELSE 0 END AS saved_basis_points FROM t",
    "host_round_robin": f"SELECT page_id, {HOST_SQL} AS host, row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY {HOST_SQL}) AS host_first FROM pages",
    "host_soft_cap": f"WITH r AS (SELECT page_id, {HOST_SQL} AS host, row_number() OVER (PARTITION BY {HOST_SQL} ORDER BY page_id) AS turn, min(page_id) OVER (PARTITION BY {HOST_SQL}) AS host_first FROM pages) SELECT page_id, host FROM r ORDER BY turn, host_first LIMIT 100",
    "unique_urls_first_seen": f"WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || {HOST_SQL} || '/' || (page_id % 10) AS url FROM pages) SELECT url, min(page_id) AS first_page_id, count(*) AS seen FROM u GROUP BY url",
    "url_drop_reasons": f"WITH {_REQUESTED_SQL} SELECT CASE WHEN NOT regexp_matches(lower(url), '^https?:') THEN 'unsupported scheme' ELSE 'kept' END AS reason, count(*) AS urls FROM q GROUP BY ALL",
}
