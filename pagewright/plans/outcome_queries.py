"""Queries over outcomes of requests made from events: error classes, budgets, formats, flags, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import fixed as V
from pagewright.functions import outcomes as O
from pagewright.operators import requests as R
from pagewright.plans.augment import read

_TYPES = ["httpx.ReadTimeout", "httpx.HTTPStatusError", "PolicyBlockedError", "ValueError", "OSError", "httpx.ConnectError", "RuntimeError", "KeyError"]
_STATUSES = [404, 429, 503, 500, 403]
_MESSAGES = ["Job queue is full", "host resolves to blocked range", "it broke", "Job queue is closing", "no such page", "Blocked IP 10.0.0.1"]
_CONTENT = ["text/html; charset=utf-8", "Application/XHTML+XML", "image/png", None, "text/xml ;q=1"]


def _pick(values: list, n) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (n % len(values) + 1).cast("int"))


def _failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", _pick(_TYPES, n).alias("error_type"), _pick(_STATUSES, n).alias("status"), _pick(_MESSAGES, n).alias("error"), _pick(_CONTENT, n).alias("content_type"), "value"
    )


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_FAILED_SQL = "f AS (SELECT event_id, user_id, value, regexp_extract({t}[event_id % {nt} + 1], '([^.]*)$', 1) AS name, {s}[event_id % {ns} + 1] AS status, {m}[event_id % {nm} + 1] AS error, {c}[event_id % {nc} + 1] AS ct FROM events)".format(
    t=_list(_TYPES), nt=len(_TYPES), s=_list(_STATUSES), ns=len(_STATUSES), m=_list(_MESSAGES), nm=len(_MESSAGES), c=_list(_CONTENT), nc=len(_CONTENT)
)


def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _failed(spark, sf_dir).select(O.class_name(F.col("error_type")).alias("name"), "status", O.is_retryable(F.col("error_type"), F.col("status")).alias("retryable"))
    return rows.groupBy("name", "status", "retryable").agg(F.count("*").alias("errors"))


def error_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = O.http_status(F.col("error_type"), F.col("error"), F.col("status"))
    return _failed(spark, sf_dir).groupBy(status.alias("http_status")).agg(F.count("*").alias("errors"))


def public_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(spark, sf_dir).select("event_id", O.public_error(F.col("error"), F.col("error_type")).alias("public_error"))


def html_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failed(spark, sf_dir).groupBy("content_type", O.is_html(F.col("content_type")).alias("is_html")).agg(F.count("*").alias("answers"))


def pinned_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a name server with one, two or no addresses, some of them private."""
    second = _pick(["8.8.4.4", "10.0.0.1", "1.1.1.1", "169.254.169.254"], F.col("event_id"))
    own = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 3 == 0, F.array(F.lit("9.9.9.9"))).otherwise(F.array(F.lit("8.8.8.8"), second))
    return read(spark, sf_dir, "events").select("event_id", O.pinned_address(own).alias("address"))


def render_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = F.when(F.col("user_id") % 4 > 0, (F.col("user_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(O.cost_units((F.col("event_id") % 6).cast("int"), budget).alias("x"))
    return rows.groupBy(F.col("x.cost").alias("cost"), F.col("x.exceeded").alias("exceeded")).agg(F.count("*").alias("requests"))


def render_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose words decide, whatever their URL, whether a browser is needed."""
    words = F.regexp_count("html", F.lit(r"[A-Za-z0-9_]+"))
    skip = O.skip_render(words, F.lit(400), F.concat(F.lit("https://h.example/p"), F.when(F.col("page_id") % 9 == 0, ".pdf").otherwise("")), F.lit(True))
    return read(spark, sf_dir, "pages").select("page_id", skip.alias("skip"))


def output_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by what is asked for and what a document has."""
    asked = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("chunks"), F.lit("blocks"), F.lit("chunks"))).otherwise(F.array(F.lit("metadata")))
    has = F.when(F.col("page_id") % 3 == 0, F.array(F.lit("markdown"))).otherwise(F.array(*[F.lit(x) for x in ("markdown", "blocks", "chunks", "metadata")]))
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(O.emitted_formats(asked, has), ",").alias("formats"))


def flag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")), F.lit("x"))
    other = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("x"), F.lit("f1")))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(O.union_of_flags(own, other), "|").alias("flags"))


def throttled_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    interval = (F.col("user_id") % 50).cast("double")
    rows = _failed(spark, sf_dir).select("status", O.throttled(interval, F.col("status")).alias("interval"))
    return rows.groupBy("status", "interval").agg(F.count("*").alias("answers"))


def stage_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.floor(F.col("value") * 100).cast("bigint").alias("ms"))
    return R.stage_timings(rows)


def benchmark_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean time and mean reduction, in whole units, over all runs with a count before and after."""
    rows = read(spark, sf_dir, "events").select(F.floor(F.col("value") * 100).cast("bigint").alias("ms"), (F.col("event_id") % 90 + 10).alias("before"), (F.col("event_id") % 10).alias("after"))
    return R.benchmark_totals(rows)


def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a restart: what ran without an owner fails, and jobs without a time to live get one."""
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"), _pick(["queued", "running", "completed", "failed"], F.col("event_id")).alias("status"),
        F.when(F.col("event_id") % 3 == 0, F.lit("worker-1")).alias("owner"), F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 5 * 60).cast("int")).alias("ttl_seconds"),
    )
    return R.recovered_jobs(rows, owners=["worker-1"], ttl=3600).select("job_id", "status", "ttl_seconds", "error")


QUERIES = {
    f.__name__: f
    for f in (
        retryable_errors, error_statuses, public_errors, html_types, pinned_addresses, render_budget, render_skipped, output_formats, flag_union, throttled_hosts,
        stage_timings, benchmark_totals, job_recovery,
    )
}

_QUOTED = lambda values: ", ".join(f"'{x}'" for x in values)
_CASES = " ".join(f"WHEN name IN ({_QUOTED(names)}) THEN {code}" for names, code in V.ERROR_STATUSES)
_MARKED = " OR ".join(f"contains(lower(error), '{x}')" for x in V.PRIVATE_MARKERS)

ORACLE_SQL = {
    "retryable_errors": f"WITH {_FAILED_SQL} SELECT name, status, name <> 'PolicyBlockedError' AND (name IN ({_QUOTED(V.RETRYABLE_ERRORS)}) OR name = 'HTTPStatusError' AND status IN {tuple(V.RETRYABLE_STATUSES)}) AS retryable, count(*) AS errors FROM f GROUP BY ALL",
    "error_statuses": f"WITH {_FAILED_SQL} SELECT CAST(CASE {_CASES} WHEN error = '{V.QUEUE_FULL}' THEN 429 WHEN error IN ({_QUOTED(V.QUEUE_UNAVAILABLE)}) THEN 503 WHEN name = 'HTTPStatusError' THEN CASE WHEN status BETWEEN 400 AND 499 THEN status ELSE 502 END WHEN name = 'PolicyBlockedError' THEN 403 END AS INTEGER) AS http_status, count(*) AS errors FROM f GROUP BY ALL",
    "public_errors": f"WITH {_FAILED_SQL} SELECT event_id, CASE WHEN name = 'PolicyBlockedError' THEN 'Content blocked by security policy' WHEN name = 'ValueError' THEN 'Invalid request' WHEN name IN ({_QUOTED(V.PRIVATE_ERRORS)}) THEN 'Internal server error' WHEN {_MARKED} THEN 'Invalid request' ELSE error END AS public_error FROM f",
    "html_types": f"WITH {_FAILED_SQL} SELECT ct AS content_type, coalesce(lower(trim(string_split(ct, ';')[1])) IN ({_QUOTED(V.HTML_TYPES)}), false) AS is_html, count(*) AS answers FROM f GROUP BY ALL",
    "pinned_addresses": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '9.9.9.9' WHEN event_id % 4 IN (0, 2) THEN '8.8.8.8' END AS address FROM events",
    "render_budget": "WITH r AS (SELECT least(5, 1 + event_id % 6) AS cost, CASE WHEN user_id % 4 > 0 THEN user_id % 4 + 1 END AS budget FROM events) SELECT CAST(cost AS INTEGER) AS cost, coalesce(cost > budget, false) AS exceeded, count(*) AS requests FROM r GROUP BY ALL",
    "render_skipped": "SELECT page_id, len(regexp_extract_all(html, '[A-Za-z0-9_]+')) >= 400 OR page_id % 9 = 0 AS skip FROM pages",
    "output_formats": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'markdown' WHEN page_id % 2 = 0 THEN 'chunks,blocks,markdown,metadata' ELSE 'metadata,markdown,blocks,chunks' END AS formats FROM pages",
    "flag_union": "SELECT event_id, 'f' || (event_id % 3) || '|x' || CASE WHEN event_id % 2 = 0 AND event_id % 3 <> 1 THEN '|f1' ELSE '' END AS flags FROM events",
    "throttled_hosts": f"WITH {_FAILED_SQL} SELECT status, CASE WHEN status IN (403, 429) THEN least(CAST(60 AS DOUBLE), greatest(CAST(user_id % 50 AS DOUBLE), 1) * 2) ELSE CAST(user_id % 50 AS DOUBLE) END AS interval, count(*) AS answers FROM f GROUP BY ALL",
    "stage_timings": "WITH r AS (SELECT event_type AS stage, CAST(floor(value * 100) AS BIGINT) AS ms FROM events) SELECT stage, count(*) AS runs, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS most_ms, min(ms) AS least_ms FROM r GROUP BY stage",
    "benchmark_totals": "WITH r AS (SELECT CAST(floor(value * 100) AS BIGINT) AS ms, event_id % 90 + 10 AS before, event_id % 10 AS after FROM events) SELECT count(*) AS runs, CAST(sum(ms) // count(*) AS BIGINT) AS mean_ms, CAST(sum(greatest(before - after, 0) * 10000 // before) // count(*) AS BIGINT) AS mean_reduction_basis_points FROM r",
    "job_recovery": "SELECT event_id AS job_id, CASE WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN 'failed' ELSE ['queued', 'running', 'completed', 'failed'][event_id % 4 + 1] END AS status, CAST(CASE WHEN event_id % 5 > 0 THEN event_id % 5 * 60 ELSE 3600 END AS INTEGER) AS ttl_seconds, CASE WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN 'lost by its worker' END AS error FROM events",
}
