import random

from pyspark.sql import functions as F

from pagewright.operators import requests as R
from pagewright.sources.tables import policies
from pagewright.streaming import requests as S

ROWS = [("a", i, float(t), ok) for i, (t, ok) in enumerate([(0, False), (1, False), (2, True), (3, True), (70, False), (71, True), (72, False)])] + [("b", 9, 5.0, True)]
SCHEMA = "host string, index long, t double, ok boolean"


def streamed(spark, tmp_path, transform, name):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    query = transform(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"SELECT * FROM {name} ORDER BY host, index").collect()


def test_breaker_stream_equals_batch(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: S.breaker_stream(s, most=2, pause=60.0), "breaker")
    wanted = S.breaker_batch(spark.createDataFrame(ROWS, SCHEMA), most=2, pause=60.0).orderBy("host", "index").collect()
    assert got == wanted
    assert [r["admitted"] for r in wanted if r["host"] == "a"] == [True, True, False, False, True, False, False]


def test_slots_stream_equals_window(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda s: S.host_slots(s, 2.0), "slots")
    wanted = R.host_slots(spark.createDataFrame(ROWS, SCHEMA), 2.0).orderBy("host", "index").collect()
    assert [r["slot"] for r in got] == [r["slot"] for r in wanted] == [0.0, 2.0, 4.0, 6.0, 70.0, 72.0, 74.0, 5.0]


def test_requests(spark):
    rows = spark.createDataFrame([(i, "k" if i < 3 else "l") for i in range(4)], "index long, request_key string")
    assert [r["is_leader"] for r in R.leaders(rows).orderBy("index").collect()] == [True, False, False, True]
    assert R.batch_summary(spark.createDataFrame([], "ok boolean")).first()["success_rate"] == 0.0
    plan = R.retry_schedule(3, 30, 50)
    assert [tuple(x) for x in spark.range(1).select(plan.alias("x")).first()["x"]] == [(0, 30, 1), (1, 50, 2), (2, 50, 4)]
    assert spark.range(1).select(R.retry_after(F.lit(503), F.lit(1), F.lit(40.0)).alias("x")).first()["x"] == 10.0


def test_slots_and_windows_over_ranges_equal_plain_loops(spark):
    """A busy host over several ranges, ties, a null host and repeated rows."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.choice([0, 5, 86395, 86400, 86401, 172790, 500000]) + rng.randint(0, 9)) for i in range(300)]
    table = spark.createDataFrame(rows, "host string, index long, t long")
    slot, free = {}, {}
    for host, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        slot[i] = max(t, free.get(host, t))
        free[host] = slot[i] + 600
    assert {r["index"]: r["slot"] for r in R.host_slots(table, 600).collect()} == slot
    for seconds in (10, 100000):
        wanted = {i: sum(h == host and t - seconds <= u <= t for h, _, u in rows) for host, i, t in rows}
        got = R.in_window(table, seconds, client="host").collect()
        assert len(got) == len(rows) and {r["index"]: r["calls"] for r in got} == wanted


def test_breaker_carries_its_state_over_batches(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), i, float(rng.randint(0, 900)), rng.random() < 0.4) for i in range(200)]
    breakers, wanted = {}, {}
    for host, i, t, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        wanted[i] = breakers.setdefault(host, S.Breaker(2, 60.0, 300.0)).see(t, ok)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = S.breaker_batch(spark.createDataFrame(rows, SCHEMA), 2, 60.0, 300.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["index"]: r["admitted"] for r in got} == wanted


def test_policies_keep_the_order_of_their_file(spark, tmp_path):
    path = tmp_path / "policies.json"
    path.write_text('[{"domain": "b.org", "notes": "x"}, {"domain": "a.org", "blocked_tags": ["table"]},\n {"domain": "c.org", "priority": 9}]')
    got = policies(spark, str(path)).orderBy("priority").collect()
    assert [(r["priority"], r["domain"], r["blocked_tags"]) for r in got] == [(0, "b.org", None), (1, "a.org", ["table"]), (9, "c.org", None)]
    path.write_text('{"domain": "d.org"}')
    assert [r["domain"] for r in policies(spark, str(path)).collect()] == ["d.org"]
