"""The corpus pipeline against the same decisions made one document at a time."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from pagewright.llm import language_id as L
from pagewright.llm import packing as P
from pagewright.llm import toxicity as T
from pagewright.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_dedup import brute_near
from tests.llm.test_models import text, toxic_corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, nulls, empty and toxic texts, and their labels."""
    rng, rows = random.Random(9), []
    toxic = toxic_corpus()
    for i, t, _ in toxic:
        rows.append((i, t, "aa", "s", len(t)))
    for i in range(1000, 1100):
        t = text(rng, "bb", 60)
        rows += [(i, t, "bb", "s", len(t)), (i + 1000, t, "bb", "s", len(t)), (i + 2000, t + " more", None, "s", len(t))]
    rows += [(5000, None, "aa", "s", 0), (5001, "", "aa", "s", 0), (5002, "12 34", "aa", "s", 5), (1000, rows[900][1], "bb", "s", 0), (None, rows[900][1], "bb", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_decide_as_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    path = folder + "/stages"
    known = L.identify(docs, L.learn(L.labelled_rows(docs)), keep=("text",)).collect()
    kept = [r for r in known if r.lang_pred != "und" and r.score >= C.LEAST_LANGUAGE]
    left = C.language(spark, docs, folder)
    assert left.columns == docs.columns == C.COLUMNS
    left.write.parquet(f"{path}/1")
    left = spark.read.parquet(f"{path}/1")
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(((r.doc_id, r.text) for r in kept), key=str)

    model = T.learn(T.labelled_rows(left, labels))
    bad = {r.doc_id for r in T.toxicity(left, model).where("predicted = 1").collect()}
    assert len(bad) > 100
    wanted = [r for r in left.collect() if r.doc_id not in bad]
    left = C.toxic(spark, left, folder)
    left.write.parquet(f"{path}/2")
    left = spark.read.parquet(f"{path}/2")
    assert sorted(left.collect(), key=str) == sorted(wanted, key=str)

    first = {}
    for r in wanted:
        if r.doc_id is not None:
            first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
    left = C.exact_duplicates(spark, left, folder)
    left.write.parquet(f"{path}/3")
    left = spark.read.parquet(f"{path}/3")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted((i, t) for t, i in first.items())

    rows = sorted((r.doc_id, r.text) for r in left.collect())
    near = [rows[i] for i, _, _, keep in brute_near([t for _, t in rows], 5, 80) if keep]
    left = C.near_duplicates(spark, left, folder)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == near and len(near) < len(rows)

    packed = C.run(spark, folder).collect()
    pieces = {(r.doc_id, r.piece): r.ids_crc32 for r in packed}
    import pyarrow as pa

    ids = P.token_ids(pa.array([t for _, t in near]))
    assert pieces == {(i, p): zlib.crc32(x[lo : lo + P.TOKENS].astype("<u4")) for (i, _), x in zip(near, ids, strict=True) for p, lo in enumerate(range(0, len(x), P.TOKENS))}


def test_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in C.STAGES:
        assert stage(spark, none, folder).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_covers_its_table(spark, name):
    """One row for each row of the table, but for searches, pieces and the audit, which has one for each part, order and step."""
    got = QUERIES[name](spark, SF)
    source = "embeddings" if name.startswith(("op4", "op11")) else "pages" if name.startswith(("op5", "op7")) else "documents"
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name.startswith("op4"):
        assert got.select("query_id").distinct().count() == spark.read.parquet(f"{SF}/{source}.parquet").where("vec_id % 50 = 0").count()
    elif name.startswith("op11"):
        assert got.select("anchor_id").distinct().count() == spark.read.parquet(f"{SF}/{source}.parquet").where("vec_id % 50 = 0").count()
    elif name.startswith("op12"):
        assert got.count() == 600 * spark.read.parquet(f"{SF}/{source}.parquet").select("source").distinct().count()
    elif name.startswith("op8"):
        assert got.select("doc_id").distinct().count() == n
    else:
        assert got.count() == n


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    wanted = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in wanted.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(wanted.fetchall())


def test_an_id_with_two_texts_loses_only_the_near_copy(spark, folder):
    rng = random.Random(2)
    x, y = text(rng, "aa", 60), text(rng, "bb", 60)
    rows = [(1, y, "bb", "s", 0), (2, x, "aa", "s", 0), (2, y + " more", "bb", "s", 0)]
    left = C.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), folder)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, y), (2, x)]


def test_near_stage_filters_texts_before_it_joins_them(spark, monkeypatch):
    """No anti-join on the way of the texts, as Spark pushes it below the filter of keys and then shuffles all of them."""
    from pagewright.llm import near_dedup

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (3, None)], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    found = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.expr("coalesce(doc_id, 0) = 1 AND text = 'a' OR doc_id = 3").alias("kept"))
    monkeypatch.setattr(near_dedup, "near_dedup", lambda *a, **k: found)
    out = C.near_duplicates(spark, rows, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__held" in plan and "LeftAnti" not in plan
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, rows.where("doc_id IS NULL OR doc_id = 3 OR doc_id = 1 AND text = 'a'").select("doc_id", "text").collect()))
