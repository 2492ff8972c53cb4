"""A corpus pipeline: language, toxicity, exact and near duplicates, then packing into sequences.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of ``documents``; the
last one returns the packed pieces. ``run`` writes each stage's result as Parquet to the shared folder and gives what it
reads back to the next.

The language stage keeps documents whose text is in a learned language with a posterior of ``LEAST_LANGUAGE`` or more.
The toxicity stage drops those predicted toxic. The duplicate stages keep one document of each group, the one with the
smallest id. Null and empty texts have no language and go at the first stage. The exact stage keeps one of the rows
that have a text, with a null id only if all have; the near stage decides about rows that share an id by each one's
text, and keeps those with a null id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.base import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pagewright.llm import language_id as op

    found = op.identify(docs, op.learn(op.labelled_rows(docs)), keep=("text", "lang", "source", "n_chars"))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE)).select(COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pagewright.llm import toxicity as op

    model = op.learn(op.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return op.toxicity(docs, model, keep=("text", "lang", "source", "n_chars")).where("predicted = 0").select(COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pagewright.llm.exact_dedup import distinct_texts

    return distinct_texts(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pagewright.llm.membership import split
    from pagewright.llm.near_dedup import near_dedup

    dropped = near_dedup(docs, width=5, percent=80, hashed=True).where("not kept and doc_id is not null")
    dropped = cut(dropped.select("doc_id", "text_hash").distinct(), "dropped")
    kept, maybe = split(docs.withColumn("text_hash", F.xxhash64("text")), ["doc_id", "text_hash"], dropped)
    # As an anti-join, Spark would do this below the filter, and shuffle all texts.
    marked = maybe.join(dropped.withColumn("__dropped", F.lit(True)), ["doc_id", "text_hash"], "left")
    return kept.unionByName(marked.where("__dropped is null").drop("__dropped")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pagewright.llm.packing import pack

    return pack(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("packing", packed),
]

#: Language and toxicity are learned models, which SQL does not express; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
