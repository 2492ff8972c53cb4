"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams by language come from the labelled rows, summed on the executors; the log-probability matrix
(buckets x languages, bounded by both parameters) is broadcast, and each Arrow batch is scored by gathering the rows of
the n-grams that occur and summing them by document. Whole texts count, in blocks.

Training reads at most about ``sample_rows`` labelled rows (a hash of the id chooses them, so the choice does not depend
on partitions); all of them where there are no more.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if nothing was learned; score is the
posterior of the predicted language; ties go to the language that sorts first; rows with a null id are never held out
and never learned from; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, drop_tables, mix64, text_blocks
from pagewright.llm.words import _grown

GRAMS = (1, 2, 3)
BUCKETS = 1 << 15
#: Labelled rows that training reads, about, at most.
SAMPLE_ROWS = 65_536
#: Tasks that count n-grams of the sample.
SAMPLE_TASKS = 24
SMOOTHING = 0.5
#: Bytes of text scored at once: a byte costs about 100 bytes of arrays on the way.
SCORED_BYTES = 1 << 18

# ASCII letters count in lower case; any other ASCII byte is the same blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[_FOLD]


class Model(NamedTuple):
    languages: list[str]
    log_prob: np.ndarray  # (BUCKETS, languages) float32
    prior: np.ndarray


def grams(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the n-grams of characters that lie within a document, for each n."""
    if not len(raw):
        return
    opens = np.flatnonzero((raw & 0xC0) != 0x80)
    power, inverse = _grown(len(raw))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=run[1:])
    edges = np.append(opens, len(raw))
    document = np.searchsorted(at, opens, side="right") - 1
    last = at[document + 1]
    for n in GRAMS:
        if len(opens) < n:
            return
        end = edges[n:]
        begin = opens[: len(end)]
        inside = end <= last[: len(end)]
        value = (run[end] - run[begin]) * inverse[begin]
        value = (value ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        bucket = (value >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int32)
        yield document[: len(end)][inside], bucket[inside]


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """About ``most`` of the rows, chosen by a hash of their id; all if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(17), F.col(id_col)), F.lit(1 << 30)) < int((1 << 30) * most / n))


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``labelled``: id, text, label, none null."""
    rows = sampled(labelled, "id", sample_rows).select("text", "label").repartition(SAMPLE_TASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        counts: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            label = np.array(batch.column(1).to_pylist(), object)
            for x in label:
                documents[x] = documents.get(x, 0) + 1
            for lo, hi, raw, at in text_blocks(batch.column(0), SCORED_BYTES):
                own = label[lo:hi]
                names, code = np.unique(own.astype(str), return_inverse=True)
                for document, bucket in grams(raw, at):
                    found = np.bincount(code[document].astype(np.int64) * BUCKETS + bucket, minlength=len(names) * BUCKETS)
                    for i, name in enumerate(names):
                        counts[name] = counts.get(name, 0) + found[i * BUCKETS : (i + 1) * BUCKETS]
        for name, n in documents.items():
            dense = counts.get(name, np.zeros(BUCKETS, np.int64))
            at = np.flatnonzero(dense)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(dense[at], n).astype(np.int64))],
                names=["label", "bucket", "n"],
            )

    found = rows.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["label"].unique())
    counts = np.zeros((BUCKETS, len(languages)))
    prior = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = found[found["label"] == name]
        bucket, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        counts[bucket[bucket >= 0], i] = n[bucket >= 0]
        prior[i] = n[bucket < 0].sum()
    counts += SMOOTHING
    log_prob = np.log(counts / counts.sum(axis=0)) if languages else counts
    return Model(languages, log_prob.astype(np.float32), np.log(prior / prior.sum()) if languages else prior)


def score(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language, its posterior) of each text."""
    best, sure = np.zeros(len(column), np.int64), np.zeros(len(column))
    for lo, hi, raw, at in text_blocks(column, SCORED_BYTES):
        total = np.tile(model.prior, (hi - lo, 1))
        for document, bucket in grams(raw, at):
            if len(document):
                first = np.flatnonzero(np.diff(document, prepend=-1))
                total[document[first]] += np.add.reduceat(model.log_prob[bucket], first, axis=0, dtype=np.float64)
        best[lo:hi] = total.argmax(axis=1)
        sure[lo:hi] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return best, sure


def bucket_of(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(modulus))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, ``keep``'s columns, lang_pred, score."""
    spark = docs.sparkSession
    arrow_rows(spark)
    sent = spark.sparkContext.broadcast(model)
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    names = [id_col, *keep]
    rows = docs.select(F.col(text_col).alias("in_text"), letters.alias("in_letters"), *(F.col(c).alias(f"in_{i}") for i, c in enumerate(names)))
    types = [f.dataType.simpleString() for f in rows.schema.fields[2:]]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(names, types, strict=True)), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        languages = np.array([*sent.value.languages, "und"], object)
        for batch in batches:
            known = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if len(languages) > 1:
                best, sure = score(sent.value, batch.column(0))
            else:
                best, sure = np.zeros(len(known), np.int64), np.zeros(len(known))
            name = pa.array(languages[np.where(known, best, -1)], pa.string())
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, name, pa.array(np.where(known, sure, 0.0))], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def labelled_rows(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """id, text and label of the documents to learn from: lang given, and not in the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), modulus) != held_out))
    return rows.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"))
