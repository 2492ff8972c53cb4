"""The in-flight stream over several micro-batches against brute force; the file sink with failing tasks and aborts."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagewright.sources import batch_files as B
from pagewright.streaming import inflight as I

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute(rows, mark):
    out = []
    for key in {k for k, *_ in rows}:
        leader, followers = None, []

        def done(leader, followers, key=key):
            return [(key, i, leader[0], len(followers), leader[2]) for i in [leader[0], *followers]]

        for _, i, t, takes in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            if leader and t < leader[1]:
                followers.append(i)
                continue
            if leader:
                out += done(leader, followers)
            takes = float("inf") if takes is None else takes
            leader, followers = (i, t + min(takes, I.EXPIRY), takes <= I.EXPIRY), []
        if leader[1] <= mark:
            out += done(leader, followers)
    return sorted(out)


def test_in_flight_stream(spark, tmp_path):
    """Four files, a micro-batch each; a leader of one batch is followed, and done, in a later one."""
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 5.0, 60.0, 700.0])
        rows.append((rng.choice("abc"), i, t, rng.choice([10.0, 300.0, 900.0, 901.0, None])))
    schema = "request_key string, id long, ts timestamp, takes double"
    for part in range(4):
        some = [(k, i, START + timedelta(seconds=t), takes) for k, i, t, takes in rows[part * 100 : part * 100 + 100]]
        some += [(None, 1, START, 1.0), ("a", None, START, 1.0), ("a", 1, None, 1.0)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            if name.endswith(".parquet") and not name.startswith("n"):
                os.rename(tmp_path / "in" / name, tmp_path / "in" / f"n{part}.parquet")
                os.utime(tmp_path / "in" / f"n{part}.parquet", (part + 1_000_000, part + 1_000_000))
        for name in os.listdir(tmp_path / "in"):
            if name.endswith(".crc"):
                os.remove(tmp_path / "in" / name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = I.run_available(I.followed(stream), "test-inflight").collect()
    mark = max(t for _, _, t, _ in rows) - 60
    assert sorted(tuple(r) for r in got) == brute(rows, mark)
    assert any(r["followers"] for r in got) and any(not r["ok"] for r in got)


def test_repeated_ids_share_a_leader(spark, tmp_path):
    """Rows of one id that takes no time are one group, as the SQL of ``stream_dedup`` counts them."""
    rows = [("a", 1, 0.0, 0.0)] * 3 + [("a", 2, 5.0, 60.0)] * 2 + [("a", 3, 30.0, 0.0), ("a", 4, 500.0, 0.0), ("b", 5, 900.0, 0.0)]
    schema = "request_key string, id long, ts timestamp, takes double"
    spark.createDataFrame([(k, i, START + timedelta(seconds=t), takes) for k, i, t, takes in rows], schema).write.parquet(str(tmp_path / "in"))
    got = I.run_available(I.followed(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "test-repeated").collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, 1, 2, True)] * 3 + [("a", 2, 2, 2, True)] * 2 + [("a", 3, 2, 2, True), ("a", 4, 4, 0, True)]


def documents(spark, n):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("# é\r\n"), F.col("id").cast("string")).alias("markdown"), F.when(F.col("id") % 4 == 1, "failed").alias("error"))


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    B.write_documents(documents(spark, 30).repartition(3), path)
    got = {r["n"]: r["markdown"] for r in B.read_documents(spark, path).collect()}
    assert got == {i: f"# é\r\n{i}" for i in range(30) if i % 4 != 1}
    assert json.loads((tmp_path / "out/summary.json").read_text()) == {"total": 30, "successful": 22, "failed": 8}
    assert sorted(os.listdir(tmp_path / "out"))[-1] == "summary.json" and not (tmp_path / "out" / B.STAGING).exists()
    errors = [json.loads(x) for d in (tmp_path / "out").glob("part-*") for x in (d / "errors.jsonl").read_text().splitlines()]
    assert sorted(e["n"] for e in errors) == [i for i in range(30) if i % 4 == 1]
    assert len(list((tmp_path / "out").rglob("doc_007.md"))) == 1


def test_tasks_read_many_files(spark, tmp_path, monkeypatch):
    """A folder of few files is one task; shares of a larger one have each file once; a folder without any has no rows."""
    B.write_documents(documents(spark, 200).coalesce(1), str(tmp_path / "out"))
    assert B.read_documents(spark, str(tmp_path / "out")).rdd.getNumPartitions() == 1
    monkeypatch.setattr(B, "FILES_OF_A_TASK", 40)
    reader = B.BatchReader(str(tmp_path / "out"))
    shares = [[n for batch in reader.read(p) for n in batch["n"].to_pylist()] for p in reader.partitions()]
    assert len(shares) == 4 and all(shares) and sorted(sum(shares, [])) == [i for i in range(200) if i % 4 != 1]
    (tmp_path / "none").mkdir()
    assert B.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    @F.udf(StringType())
    def fails(i):
        if i == 17:
            raise ValueError("a task is lost")
        return str(i)

    path = f"file://{tmp_path}/out"
    docs = documents(spark, 30).repartition(3).withColumn("markdown", fails("page_id"))
    with pytest.raises(Exception, match="a task is lost"):
        B.write_documents(docs, path)
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []


def test_a_repeated_attempt_counts_once(tmp_path):
    """What an attempt wrote whose message Spark doesn't pass on goes with the staging folder."""
    class Row(dict):
        pass

    rows = [Row(n=1, markdown="a", error=None), Row(n=2, markdown=None, error="x")]
    writer = B.BatchWriter(str(tmp_path), False)
    writer.begin()
    writer.write(iter(rows))
    again = writer.write(iter(rows))
    writer.commit([again, None])
    assert len(list(tmp_path.rglob("doc_001.md"))) == 1 and not (tmp_path / B.STAGING).exists()
    assert json.loads((tmp_path / "summary.json").read_text()) == {"total": 2, "successful": 1, "failed": 1}


def test_columns_are_checked(spark, tmp_path):
    spark.dataSource.register(B.BatchFiles)
    with pytest.raises(Exception, match="columns are missing"):
        spark.range(1).write.format("pagewright_batch").option("path", str(tmp_path)).mode("append").save()
