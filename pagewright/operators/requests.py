"""Requests and their outcomes: leaders and followers, cache, jobs, batches, statistics, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.fixed import OPEN_JOB_STATES


def request_key(*fields: Column) -> Column:
    """A hash of the fields' canonical JSON."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def leaders(requests: DataFrame, key: str = "request_key", order: str = "index") -> DataFrame:
    """Each request with its leader's index (the first of the key) and how many follow.

    The leader is an aggregate joined back, so requests of one key need not meet in a task.
    """
    first = requests.groupBy(key).agg(F.min(order).alias("leader"), (F.count("*") - 1).alias("followers"))
    joined = requests.join(first, key)
    return joined.withColumn("is_leader", F.col(order) == F.col("leader"))


def cache_hits(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    return requests.join(cache.where(F.col("expires_at") > now).select("key").distinct(), "key", "left_semi")


def cache_misses(requests: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    return requests.join(cache.where(F.col("expires_at") > now).select("key").distinct(), "key", "left_anti")


def cache_upsert(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The newest entry of each key."""
    every = cache.unionByName(entries)
    return every.groupBy("key").agg(F.max_by(F.struct(*[c for c in every.columns if c != "key"]), "created_at").alias("e")).select("key", "e.*")


def newest(cache: DataFrame, n: int, by: str = "created_at") -> DataFrame:
    """The ``n`` entries that stay when the least recent are evicted."""
    return cache.orderBy(F.desc(by), "key").limit(n)


def visible_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs that are open, or completed within their time to live."""
    fresh = now <= F.col("completed_at") + F.make_interval(secs=F.col("ttl_seconds"))
    return jobs.where(F.col("status").isin(OPEN_JOB_STATES) | F.coalesce(fresh, F.lit(False)))


def latest_state(changes: DataFrame, key: str = "job_id") -> DataFrame:
    """The last change of each job, by time and then by number."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), F.struct("ts", "number")).alias("x")).select(key, "x.*")


def batch_summary(outcomes: DataFrame) -> DataFrame:
    total, good = F.count("*"), F.count_if("ok")
    return outcomes.agg(total.alias("total"), good.alias("successful"), (total - good).alias("failed"), F.when(total > 0, good * 100 / total).otherwise(0.0).alias("success_rate"))


def errors_by_url(outcomes: DataFrame) -> DataFrame:
    """Errors of each URL in the order of the batch, repeats included."""
    pairs = F.sort_array(F.collect_list(F.struct("index", "error")))
    return outcomes.where("not ok").groupBy("url").agg(F.transform(pairs, lambda p: p["error"]).alias("errors"))


def host_slots(requests: DataFrame, interval: float, host: str = "host", at: str = "t", span: int = 86400) -> DataFrame:
    """When each request of a host may start, at least ``interval`` after the one before.

    slot(n) = max over j <= n of t(j) + (n - j) * interval: a running maximum. Requests are numbered, and maxima taken,
    within ``span`` seconds of a host; what lies before is a number and a maximum of each such range, so that a host
    with very many requests is as many tasks as it has ranges. Requests without a time come first.
    """
    mine, own = [host, "__range"], Window.partitionBy(host, "__range").orderBy(at, "index")
    earlier = Window.partitionBy(host).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    rows = requests.withColumn("__range", F.floor(F.col(at) / span)).withColumn("__n", F.row_number().over(own) - 1)
    sizes = rows.groupBy(*mine).agg(F.count("*").alias("__size"))
    before = sizes.select(*mine, F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    rows = _by_range(rows, before, host).withColumn("__n", F.col("__before") + F.col("__n")).withColumn("__base", F.col(at) - F.col("__n") * interval)
    tops = rows.groupBy(*mine).agg(F.max("__base").alias("__top"))
    above = tops.select(*mine, F.max("__top").over(earlier).alias("__above"))
    running = F.max("__base").over(own.rowsBetween(Window.unboundedPreceding, 0))
    out = _by_range(rows.withColumn("__base", running), above, host)
    return out.select(*requests.columns, (F.greatest("__base", "__above") + F.col("__n") * interval).alias("slot"))


def _by_range(rows: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``totals`` for their key and range, of which either may be null."""
    named = totals.withColumnsRenamed({key: "__key", "__range": "__of"})
    return rows.join(named, F.col(key).eqNullSafe(F.col("__key")) & F.col("__range").eqNullSafe(F.col("__of"))).drop("__key", "__of")


def in_window(calls: DataFrame, seconds: int, client: str = "client", at: str = "t") -> DataFrame:
    """How many calls a client has made in the ``seconds`` up to each call (seconds as whole numbers).

    Calls are counted within ranges of a client's time, of a day or of ``seconds`` if that is more; those of the last
    ``seconds`` of a range are copied to the next, so that a client with very many calls is many tasks. The copies don't
    come out. Calls without a time count each other.
    """
    span = max(seconds, 86400)
    mine = F.floor(F.col(at) / span)
    ranges = F.array_distinct(F.array(mine, F.floor((F.col(at) + seconds) / span)))
    copied = calls.withColumn("__range", F.explode(ranges)).withColumn("__own", F.col("__range").eqNullSafe(mine))
    window = Window.partitionBy(client, "__range").orderBy(at).rangeBetween(-seconds, 0)
    return copied.withColumn("calls", F.count("*").over(window)).where("__own").drop("__range", "__own")


def retry_schedule(attempts: int, timeout: int, most: int) -> Column:
    """(attempt, timeout, wait): 30 s more with each attempt up to ``most``; waits double up to 60 s."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(attempts - 1)),
        lambda n: F.struct(n.alias("attempt"), F.least(F.lit(most), F.lit(timeout) + n * 30).alias("timeout"), F.least(F.pow(F.lit(2.0), n), F.lit(60.0)).cast("int").alias("wait")),
    )


def retry_after(status: Column, attempt: Column, header: Column) -> Column:
    """Seconds to wait: a Retry-After up to 10; for 429 1.5 * 2^n up to 10; else half a second more each time up to 2."""
    own = F.when(status == 429, F.least(F.lit(10.0), F.lit(1.5) * F.pow(F.lit(2.0), attempt))).otherwise(F.least(F.lit(2.0), F.lit(0.5) * (attempt + 1)))
    return F.when(header.isNotNull(), F.least(F.lit(10.0), header)).otherwise(own)


def stage_timings(timings: DataFrame) -> DataFrame:
    """Runs, sum, most and least milliseconds of each stage (stage, ms)."""
    return timings.groupBy("stage").agg(F.count("*").alias("runs"), F.sum("ms").alias("total_ms"), F.max("ms").alias("most_ms"), F.min("ms").alias("least_ms"))


def benchmark_totals(runs: DataFrame) -> DataFrame:
    """Mean time and mean share saved, in hundredths of a per cent, of runs (ms, before, after), rounded down."""
    saved = F.floor(F.greatest(F.col("before") - F.col("after"), F.lit(0)) * 10000 / F.col("before"))
    return runs.agg(F.count("*").alias("runs"), F.floor(F.sum("ms") / F.count("*")).alias("mean_ms"), F.floor(F.sum(saved) / F.count("*")).alias("mean_reduction_basis_points"))


def recovered_jobs(jobs: DataFrame, owners: list[str], ttl: int) -> DataFrame:
    """Jobs after a restart: one that runs without a living owner has failed; one without a time to live gets ``ttl``."""
    lost = (F.col("status") == "running") & ~F.coalesce(F.col("owner").isin(owners), F.lit(False))
    return (
        jobs.withColumn("error", F.when(lost, F.lit("lost by its worker")))
        .withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))
        .withColumn("ttl_seconds", F.coalesce("ttl_seconds", F.lit(ttl)).cast("int"))
    )


def scenario_of(index: Column, weights: list[tuple[str, int]]) -> Column:
    """The scenario whose share of index mod total holds the index."""
    rest, out, upto = index % sum(w for _, w in weights), None, 0
    for name, w in weights:
        upto += w
        out = F.when(rest < upto, name) if out is None else out.when(rest < upto, name)
    return out


def campaign(outcomes: DataFrame) -> DataFrame:
    """By scenario, and over all of them in a row of a null scenario: requests, what came of them, seconds, requests a second.

    ``outcomes``: scenario, ok, warned, t. A second of no length gives no rate.
    """
    rows = outcomes.rollup("scenario").agg(
        F.count("*").alias("processed"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(F.col("ok") & F.col("warned")).alias("warnings"), (F.max("t") - F.min("t")).alias("seconds")
    )
    return rows.withColumn("per_second", F.when(F.col("seconds") > 0, F.col("processed") / F.col("seconds")))
