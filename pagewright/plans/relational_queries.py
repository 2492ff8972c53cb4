"""Joins, roll-ups, windows and chunk queries over requests derived from the event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.operators import chunks as C
from pagewright.operators import requests as R
from pagewright.plans.augment import read


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and outcomes from events: an event of type 'error' failed."""
    kind = F.element_at(F.array(F.lit("fast"), F.lit("render"), F.lit("auto")), (F.col("user_id") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"), F.concat(F.lit("https://h"), (F.col("user_id") % 50).cast("string"), F.lit(".example/"), (F.col("event_id") % 7).cast("string")).alias("url"),
        kind.alias("mode"), "event_type", (F.col("event_type") != "error").alias("ok"), F.concat(F.lit("failed "), (F.col("event_id") % 4).cast("string")).alias("error"),
        F.floor(F.col("value") * 100).cast("bigint").alias("ms"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("client"),
    )


_OUT = """o AS (SELECT event_id AS index, 'https://h' || (user_id % 50) || '.example/' || (event_id % 7) AS url, ['fast', 'render', 'auto'][user_id % 3 + 1] AS mode, event_type,
    event_type <> 'error' AS ok, 'failed ' || (event_id % 4) AS error, CAST(floor(value * 100) AS BIGINT) AS ms, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id AS client FROM events)"""


def leader_follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).withColumn("request_key", F.sha2(F.concat_ws("|", "url", "mode"), 256))
    return R.leaders(rows).select("index", "request_key", "leader", "followers", "is_leader")


def follower_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followers with their leader's time: an equi-join by index."""
    rows = _outcomes(spark, sf_dir).withColumn("request_key", F.concat_ws("|", "url", "mode"))
    led = R.leaders(rows)
    leader = rows.select(F.col("index").alias("leader"), F.col("ms").alias("leader_ms"))
    return led.where("not is_leader").join(leader, "leader").groupBy("mode").agg(F.count("*").alias("followers"), F.sum("leader_ms").alias("leader_ms"))


def _cache(rows: DataFrame) -> DataFrame:
    return rows.where("index % 3 = 0").groupBy(F.col("url").alias("key")).agg(F.max("t").alias("created_at"), (F.max("t") + 3600 * (F.max("index") % 5)).alias("expires_at"))


_CACHE = "c AS (SELECT url AS key, max(t) AS created_at, max(t) + 3600 * (max(index) % 5) AS expires_at FROM o WHERE index % 3 = 0 GROUP BY url)"


def _cache_case(spark: SparkSession, sf_dir: str):
    rows = _outcomes(spark, sf_dir)
    cache = _cache(rows)
    # The clock of the case: the last request, carried as a one-row table.
    now = rows.agg(F.max("t").alias("now"))
    return rows.withColumn("key", F.col("url")), cache.join(F.broadcast(now)).withColumn("expires_at", F.col("expires_at") - F.col("now"))


def cache_hit_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cache = _cache_case(spark, sf_dir)
    return R.cache_hits(rows, cache, F.lit(0)).groupBy("mode").agg(F.count("*").alias("hits"))


def cache_miss_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cache = _cache_case(spark, sf_dir)
    return R.cache_misses(rows, cache, F.lit(0)).groupBy("mode").agg(F.count("*").alias("misses"))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    entry = rows.select(F.col("url").alias("key"), F.col("index").alias("created_at"), F.col("ms").alias("document"))
    return R.cache_upsert(entry.where("created_at % 2 = 0"), entry.where("created_at % 2 = 1"))


def lru_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest(_cache(_outcomes(spark, sf_dir)).select("key", "created_at"), 20)


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.batch_summary(_outcomes(spark, sf_dir)).select("total", "successful", "failed", F.floor(F.col("success_rate") * 1000).cast("bigint").alias("success_rate_thousandths"))


def errors_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.errors_by_url(_outcomes(spark, sf_dir)).select("url", F.array_join("errors", ";").alias("errors"))


def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).where("not ok").groupBy("error").agg(F.count("*").alias("n"))


def mode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy("mode").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.floor(F.sum("ms") / F.count("*")).cast("bigint").alias("mean_ms"), F.count_if("ok").alias("successful"))


def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least, most and sample deviation of times by URL; a single run has a deviation of 0."""
    value = F.col("ms").cast("double")
    return _outcomes(spark, sf_dir).groupBy("url").agg(
        F.count("*").alias("iterations"), F.round(F.avg(value), 3).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 3).alias("stdev_ms"), F.count_if(~F.col("ok")).alias("errors"),
    )


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    return rows.agg(F.count_if(F.expr("ok and mode = 'fast'")).alias("fast_ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("index") % 3 == 0).alias("cached"), F.countDistinct("url").alias("urls"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    status = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "completed", "failed")]), (F.col("index") % 4 + 1).cast("int"))
    return rows.select((F.col("index") % 211).alias("job_id"), F.col("t").alias("ts"), F.col("index").alias("number"), status.alias("status"))


_JOBS = "j AS (SELECT index % 211 AS job_id, t AS ts, index AS number, ['queued', 'running', 'completed', 'failed'][index % 4 + 1] AS status FROM o)"


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_state(_jobs(spark, sf_dir)).select("job_id", "status", "number")


def job_illegal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of state that a job can't make, by the state before."""
    own = Window.partitionBy("job_id").orderBy("ts", "number")
    moves = _jobs(spark, sf_dir).withColumn("was", F.lag("status").over(own)).where("was is not null")
    fine = ((F.col("was") == "queued") & F.col("status").isin("running", "failed")) | ((F.col("was") == "running") & F.col("status").isin("completed", "failed"))
    return moves.where(~fine).groupBy("was", "status").agg(F.count("*").alias("moves"))


def job_ttl_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = R.latest_state(_jobs(spark, sf_dir)).select("job_id", "status", F.timestamp_seconds("ts").alias("completed_at"), ((F.col("job_id") % 9) * 86400).cast("int").alias("ttl_seconds"))
    return R.visible_jobs(jobs, F.timestamp_seconds(F.lit(1707000000))).select("job_id", "status")


def active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_state(_jobs(spark, sf_dir)).agg(F.count_if(F.col("status").isin("queued", "running")).alias("active"), F.count_if(F.col("status") == "queued").alias("pending"))


def scenario_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = R.scenario_of(F.col("index"), [("fast", 5), ("render", 2), ("strict", 1)])
    return _outcomes(spark, sf_dir).groupBy(name.alias("scenario")).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"))


def campaign_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = R.scenario_of(F.col("index"), [("fast", 5), ("render", 2), ("strict", 1)])
    rows = R.campaign(_outcomes(spark, sf_dir).select(name.alias("scenario"), "ok", (F.col("index") % 9 == 0).alias("warned"), "t"))
    return rows.select("scenario", "processed", "ok", "errors", "warnings", F.col("seconds").cast("bigint").alias("seconds"), F.floor(F.col("per_second") * 1e9).cast("bigint").alias("per_second_billionths"))


def host_slot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).select("index", F.expr("cast(client % 50 as bigint)").alias("host"), "t")
    return R.host_slots(rows, 600).select("index", "host", F.col("slot").cast("bigint").alias("slot"))


def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).select((F.col("client") % 20).alias("client"), "t", "index")
    return R.in_window(rows, 3600).select("index", "client", F.col("calls").alias("calls"), (F.col("calls") > 3).alias("limited"))


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each request, which is in one of eight attempts, how long it may take and how long it waits before."""
    attempt = (F.col("index") % 8).cast("int")
    return _outcomes(spark, sf_dir).select("index", F.get(R.retry_schedule(8, 30, 180), attempt).alias("x")).select("index", "x.*")


def retry_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir).select((F.col("index") % 2 * 74 + 429).cast("int").alias("status"), (F.col("index") % 5).cast("int").alias("attempt")).distinct()
    return rows.select("status", "attempt", R.retry_after(F.col("status"), F.col("attempt"), F.lit(None).cast("double")).alias("seconds"))


def report_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of time and host for each report, numbered from the second of a name on."""
    rows = _outcomes(spark, sf_dir).select("index", F.concat(F.date_format(F.timestamp_seconds(F.floor(F.col("t") / 86400) * 86400), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-h"), (F.col("client") % 50).cast("string")).alias("stem"))
    n = F.row_number().over(Window.partitionBy("stem").orderBy("index"))
    return rows.withColumn("n", n).select("index", F.concat("stem", F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".json")).alias("name"))


def fast_vs_render_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a URL's two documents the rendered one wins with a tenth more tokens, one at least."""
    rows = _outcomes(spark, sf_dir)
    fast = rows.where("mode = 'fast'").groupBy("url").agg(F.max("ms").alias("fast_tokens"))
    render = rows.where("mode = 'render'").groupBy("url").agg(F.max("ms").alias("render_tokens"))
    least = F.col("fast_tokens") + F.greatest(F.lit(1), F.floor(F.col("fast_tokens") / 10))
    joined = fast.join(render, "url")
    return joined.select("url", "fast_tokens", "render_tokens", F.when(F.col("render_tokens") >= least, "render").otherwise("fast").alias("winner"))


def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs with their document or error by position; an input with neither is missing."""
    rows = _outcomes(spark, sf_dir)
    docs, errors = rows.where("ok and index % 10 <> 0").select("index", F.col("ms").alias("document")), rows.where("not ok").select("index", "error")
    joined = rows.select("index").join(docs, "index", "left").join(errors, "index", "left")
    return joined.select("index", "document", F.when(F.col("document").isNull(), F.coalesce("error", F.lit("Missing result"))).alias("error"))


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outcomes(spark, sf_dir)
    return rows.select("index").join(rows.where("ok").select("index"), "index", "left_anti")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", C.line_blocks(F.col("text")).alias("blocks"))


def _chunk_query(strategy: str, overlap: int = 0):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = C.chunks(_blocks(spark, sf_dir), strategy, 400, overlap)
        return rows.select("doc_id", F.col("n").cast("bigint").alias("n"), F.size("block_ordinals").cast("bigint").alias("blocks"), F.sha2("text", 256).alias("text_sha256"), F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"))

    return query


chunk_size, chunk_heading, chunk_overlap = _chunk_query("size"), _chunk_query("heading"), _chunk_query("size", 50)


def chunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line of a text starts if lines are joined by two characters: a running sum, and the line before."""
    rows = _blocks(spark, sf_dir).select("doc_id", F.posexplode("blocks").alias("n", "b"))
    own = Window.partitionBy("doc_id").orderBy("n")
    start = F.coalesce(F.sum(F.length("b.text") + 2).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n"), start.cast("bigint").alias("char_start"), F.length(F.lag("b.text").over(own)).cast("bigint").alias("length_before"))


def _chunk_sql(heading: bool, overlap: int) -> str:
    new = "w + 2 + length(b.line) > 400"
    extra = " OR length(b.line) <= 40" if heading else ""
    prefix = f"CASE WHEN n > 0 THEN right(lag(t) OVER (PARTITION BY doc_id ORDER BY n), {overlap}) || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END" if overlap else "''"
    return f"""WITH RECURSIVE lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
        b AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM lines),
        g AS (SELECT doc_id, i, line, length(line) AS w, 0 AS g FROM b WHERE i = 1
              UNION ALL SELECT b.doc_id, b.i, b.line, CASE WHEN {new}{extra} THEN length(b.line) ELSE w + 2 + length(b.line) END, CASE WHEN {new}{extra} THEN g + 1 ELSE g END FROM g JOIN b ON b.doc_id = g.doc_id AND b.i = g.i + 1),
        c AS (SELECT doc_id, g AS n, count(*) AS blocks, string_agg(line, chr(10) || chr(10) ORDER BY i) AS t FROM g GROUP BY doc_id, g),
        s AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, {prefix} AS pre FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, blocks, sha256(pre || t) AS text_sha256, CAST(greatest(0, base - length(pre)) AS BIGINT) AS char_start, CAST(base + length(t) AS BIGINT) AS char_end FROM s"""


_STATE = "s AS (SELECT job_id, arg_max(status, (ts, number)) AS status, arg_max(number, (ts, number)) AS number, arg_max(ts, (ts, number)) AS ts FROM j GROUP BY job_id)"

QUERIES = {
    f.__name__: f
    for f in (
        leader_follower, follower_results, cache_hit_semi, cache_miss_anti, cache_upsert, lru_top_n, batch_summary, errors_by_url, error_classes, mode_stats,
        benchmark_stats, counters, job_latest_state, job_illegal_moves, job_ttl_visibility, active_jobs, scenario_allocation, campaign_totals, host_slot_window, rate_limit_window,
        retry_schedule, retry_after, report_filenames, fast_vs_render_winner, batch_rows, resume_pending, chunk_offsets,
    )
} | {"chunk_size": chunk_size, "chunk_heading": chunk_heading, "chunk_overlap": chunk_overlap}

ORACLE_SQL = {
    "leader_follower": f"WITH {_OUT}, k AS (SELECT index, sha256(url || '|' || mode) AS request_key FROM o) SELECT index, request_key, min(index) OVER w AS leader, count(*) OVER w - 1 AS followers, index = min(index) OVER w AS is_leader FROM k WINDOW w AS (PARTITION BY request_key)",
    "follower_results": f"WITH {_OUT}, k AS (SELECT *, first_value(ms) OVER w AS leader_ms, min(index) OVER (PARTITION BY url, mode) AS leader FROM o WINDOW w AS (PARTITION BY url, mode ORDER BY index)) SELECT mode, count(*) AS followers, CAST(sum(leader_ms) AS BIGINT) AS leader_ms FROM k WHERE index <> leader GROUP BY mode",
    "cache_hit_semi": f"WITH {_OUT}, {_CACHE} SELECT mode, count(*) AS hits FROM o WHERE EXISTS (SELECT 1 FROM c WHERE key = url AND expires_at > (SELECT max(t) FROM o)) GROUP BY mode",
    "cache_miss_anti": f"WITH {_OUT}, {_CACHE} SELECT mode, count(*) AS misses FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE key = url AND expires_at > (SELECT max(t) FROM o)) GROUP BY mode",
    "cache_upsert": f"WITH {_OUT} SELECT url AS key, max(index) AS created_at, arg_max(ms, index) AS document FROM o GROUP BY url",
    "lru_top_n": f"WITH {_OUT}, {_CACHE} SELECT key, created_at FROM c ORDER BY created_at DESC, key LIMIT 20",
    "batch_summary": f"WITH {_OUT} SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, CAST(floor(CAST(count(*) FILTER (WHERE ok) * 100 AS DOUBLE) / count(*) * 1000) AS BIGINT) AS success_rate_thousandths FROM o",
    "errors_by_url": f"WITH {_OUT} SELECT url, string_agg(error, ';' ORDER BY index) AS errors FROM o WHERE NOT ok GROUP BY url",
    "error_classes": f"WITH {_OUT} SELECT error, count(*) AS n FROM o WHERE NOT ok GROUP BY error",
    "mode_stats": f"WITH {_OUT} SELECT mode, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(floor(sum(ms) / count(*)) AS BIGINT) AS mean_ms, count(*) FILTER (WHERE ok) AS successful FROM o GROUP BY mode",
    "benchmark_stats": f"WITH {_OUT} SELECT url, count(*) AS iterations, round(avg(CAST(ms AS DOUBLE)), 3) AS mean_ms, min(ms) AS min_ms, max(ms) AS max_ms, round(coalesce(stddev_samp(CAST(ms AS DOUBLE)), 0), 3) AS stdev_ms, count(*) FILTER (WHERE NOT ok) AS errors FROM o GROUP BY url",
    "counters": f"WITH {_OUT} SELECT count(*) FILTER (WHERE ok AND mode = 'fast') AS fast_ok, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE index % 3 = 0) AS cached, count(DISTINCT url) AS urls FROM o",
    "job_latest_state": f"WITH {_OUT}, {_JOBS}, {_STATE} SELECT job_id, status, number FROM s",
    "job_illegal_moves": f"WITH {_OUT}, {_JOBS}, m AS (SELECT status, lag(status) OVER (PARTITION BY job_id ORDER BY ts, number) AS was FROM j) SELECT was, status, count(*) AS moves FROM m WHERE was IS NOT NULL AND NOT (was = 'queued' AND status IN ('running', 'failed') OR was = 'running' AND status IN ('completed', 'failed')) GROUP BY ALL",
    "job_ttl_visibility": f"WITH {_OUT}, {_JOBS}, {_STATE} SELECT job_id, status FROM s WHERE status IN ('queued', 'running') OR 1707000000 <= ts + (job_id % 9) * 86400",
    "active_jobs": f"WITH {_OUT}, {_JOBS}, {_STATE} SELECT count(*) FILTER (WHERE status IN ('queued', 'running')) AS active, count(*) FILTER (WHERE status = 'queued') AS pending FROM s",
    "scenario_allocation": f"WITH {_OUT} SELECT CASE WHEN index % 8 < 5 THEN 'fast' WHEN index % 8 < 7 THEN 'render' ELSE 'strict' END AS scenario, count(*) AS n, count(*) FILTER (WHERE ok) AS ok FROM o GROUP BY ALL",
    "campaign_totals": f"WITH {_OUT}, s AS (SELECT *, CASE WHEN index % 8 < 5 THEN 'fast' WHEN index % 8 < 7 THEN 'render' ELSE 'strict' END AS scenario FROM o) SELECT scenario, count(*) AS processed, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE ok AND index % 9 = 0) AS warnings, CAST(max(t) - min(t) AS BIGINT) AS seconds, CAST(floor(CAST(count(*) AS DOUBLE) / (max(t) - min(t)) * 1e9) AS BIGINT) AS per_second_billionths FROM s GROUP BY ROLLUP (scenario)",
    "host_slot_window": f"WITH {_OUT}, n AS (SELECT index, client % 50 AS host, t, row_number() OVER (PARTITION BY client % 50 ORDER BY t, index) - 1 AS n FROM o) SELECT index, CAST(host AS BIGINT) AS host, CAST(max(t - n * 600) OVER (PARTITION BY host ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 600 AS BIGINT) AS slot FROM n",
    "rate_limit_window": f"WITH {_OUT}, c AS (SELECT index, client % 20 AS client, t FROM o), w AS (SELECT index, client, count(*) OVER (PARTITION BY client ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS calls FROM c) SELECT index, client, calls, calls > 3 AS limited FROM w",
    "retry_schedule": f"WITH {_OUT} SELECT index, CAST(index % 8 AS INTEGER) AS attempt, CAST(least(180, 30 + index % 8 * 30) AS INTEGER) AS timeout, CAST(least(pow(2, index % 8), 60) AS INTEGER) AS wait FROM o",
    "retry_after": f"WITH {_OUT}, d AS (SELECT DISTINCT CAST(index % 2 * 74 + 429 AS INTEGER) AS status, CAST(index % 5 AS INTEGER) AS attempt FROM o) SELECT status, attempt, CASE WHEN status = 429 THEN least(CAST(10 AS DOUBLE), 1.5 * pow(2, attempt)) ELSE least(CAST(2 AS DOUBLE), CAST(0.5 AS DOUBLE) * (attempt + 1)) END AS seconds FROM d",
    "report_filenames": f"WITH {_OUT}, s AS (SELECT index, strftime(to_timestamp((t // 86400) * 86400) AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') || '-h' || (client % 50) AS stem FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY index) AS n FROM s) SELECT index, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.json' AS name FROM n",
    "fast_vs_render_winner": f"WITH {_OUT}, f AS (SELECT url, max(ms) AS fast_tokens FROM o WHERE mode = 'fast' GROUP BY url), r AS (SELECT url, max(ms) AS render_tokens FROM o WHERE mode = 'render' GROUP BY url) SELECT url, fast_tokens, render_tokens, CASE WHEN render_tokens >= fast_tokens + greatest(1, CAST(floor(fast_tokens / 10) AS BIGINT)) THEN 'render' ELSE 'fast' END AS winner FROM f JOIN r USING (url)",
    "batch_rows": f"WITH {_OUT} SELECT index, CASE WHEN ok AND index % 10 <> 0 THEN ms END AS document, CASE WHEN ok AND index % 10 <> 0 AND ms IS NOT NULL THEN NULL WHEN NOT ok THEN error ELSE 'Missing result' END AS error FROM o",
    "resume_pending": f"WITH {_OUT} SELECT index FROM o WHERE NOT ok",
    "chunk_size": _chunk_sql(False, 0),
    "chunk_heading": _chunk_sql(True, 0),
    "chunk_overlap": _chunk_sql(False, 50),
    "chunk_offsets": "WITH lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), b AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS n FROM lines) SELECT doc_id, n, CAST(coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start, length(lag(line) OVER (PARTITION BY doc_id ORDER BY n)) AS length_before FROM b",
}
