"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, its pairs of neighbours and its pairs with one word between,
each with value 1. Training reads at most about ``sample_rows`` labelled rows, in shards of ``SHARD_ROWS`` by a hash of
the id; each shard runs FTRL-proximal (per-coordinate rates, L1 sparsity) for a few epochs in one task, and the mean of
the shards' weights is the model. Every feature takes part; L1 alone leaves few weights other than 0, so the model is a short table, bounded by the
number of buckets, and is broadcast. Every whole text is scored, in blocks.

Defined results: a null or empty text has the bias's score; without labelled rows every score is 0.5 and nothing is
predicted; a row with a null id is never held out and never learned from; a label other than 1 counts as 0; rows that
repeat an id are scored each; a document with several labels is learned from once for each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut, drop_tables, mix64, text_blocks
from pagewright.llm.language_id import bucket_of, sampled
from pagewright.llm.words import words

BUCKETS = 1 << 22
#: Labelled rows that training reads, about, at most.
SAMPLE_ROWS = 32_768
SHARD_ROWS = 8_192
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 60.0, 0.0
#: Weight of a labelled toxic row: one that is missed costs as much as so many clean ones that are flagged.
POSITIVE = 8.0
THRESHOLD = 0.7

_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = [chr(i).isalnum() for i in range(128)]


class Model(NamedTuple):
    bias: float
    bucket: np.ndarray  # those whose weight isn't 0
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[self.bucket] = self.weight
        return out


def features(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the features of each kind, with repeats."""
    found = words(raw, at, is_word=_IS_WORD)
    h = found.hash
    document = np.repeat(np.arange(len(at) - 1), np.diff(found.first))
    shift = np.uint64(64 - (BUCKETS.bit_length() - 1))
    yield document, (h >> shift).astype(np.int32)
    for gap in (1, 2):
        if len(h) > gap:
            same = document[:-gap] == document[gap:]
            pair = mix64(h[:-gap] * np.uint64(0x9FB21C651E98DF25 + 2 * gap) + h[gap:])
            yield document[:-gap][same], (pair[same] >> shift).astype(np.int32)


def _feature_lists(rows: DataFrame) -> DataFrame:
    """shard, place, label and the sorted distinct buckets of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for batch in batches:
            lists = []
            for lo, hi, raw, at in text_blocks(batch.column(3)):
                kinds = list(features(raw, at))
                first = [np.searchsorted(d, np.arange(hi - lo + 1)) for d, _ in kinds]
                lists += [np.unique(np.concatenate([b[f[r] : f[r + 1]] for (_, b), f in zip(kinds, first, strict=True)])) for r in range(hi - lo)]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "place", "label", "x"])

    return rows.mapInArrow(run, "shard int, place long, label int, x array<int>")


def _views(column: pa.ListArray) -> Iterator[pa.Array]:
    at, values = column.offsets.to_numpy(), column.values
    return (values.slice(lo, hi - lo) for lo, hi in zip(at[:-1], at[1:], strict=True))


def ftrl(lists: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, and the buckets and weights other than 0, after ``epochs`` passes of FTRL-proximal in the given order.

    Each list holds a row's distinct buckets.
    """
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bias_z = bias_n = 0.0

    def weight(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in zip(lists, labels, strict=True):
            zx, nx = z[x], n[x]
            w, bias = weight(zx, nx, L1), float(weight(np.float64(bias_z), np.float64(bias_n), 0.0))
            g = (1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y) * (POSITIVE if y else 1.0)
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = weight(z, n, L1)
    used = np.flatnonzero(w)
    return float(weight(np.float64(bias_z), np.float64(bias_n), 0.0)), used, w[used]


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """``labelled``: id, text, label (0 or 1), none null."""
    arrow_rows(labelled.sparkSession)
    rows = sampled(labelled, "id", sample_rows)
    shards = max(1, round(min(rows.count(), sample_rows) / SHARD_ROWS))
    place = F.xxhash64(F.lit(29), "id", "label")
    rows = rows.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), F.col("label").cast("int"), "text")

    def train(part: pa.Table) -> pa.Table:
        # The lists are views of the Arrow table: the shard's features are held once.
        lists = [row.to_numpy() for chunk in part["x"].chunks for row in _views(chunk)]
        order = np.argsort(part["place"].to_numpy(), kind="stable")
        bias, at, w = ftrl([lists[i] for i in order], part["label"].to_numpy()[order])
        return pa.table({"bucket": pa.array(np.append(at, -1).astype(np.int32)), "w": pa.array(np.append(w, bias))})

    lists = cut(_feature_lists(rows), "features")
    found = lists.groupBy("shard").applyInArrow(train, "bucket int, w double").groupBy("bucket").agg(F.sum("w").alias("w")).toPandas()
    bucket, w = found["bucket"].to_numpy(np.int64), found["w"].to_numpy(np.float64) / shards
    return Model(float(w[bucket < 0].sum()), bucket[bucket >= 0], w[bucket >= 0])


def score(bias: float, weight: np.ndarray, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for lo, hi, raw, at in text_blocks(column):
        hits = []
        for document, bucket in features(raw, at):
            used = weight[bucket] != 0
            hits.append(document[used] * BUCKETS + bucket[used])
        once = np.unique(np.concatenate(hits))
        out[lo:hi] = np.bincount(once // BUCKETS, weights=weight[once % BUCKETS], minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(out + bias, -35, 35)))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: the id, ``keep``'s columns, score and predicted (1 from ``threshold`` on)."""
    spark = docs.sparkSession
    arrow_rows(spark)
    sent = spark.sparkContext.broadcast(model)
    names = [id_col, *keep]
    rows = docs.select(F.col(text_col).alias("in_text"), *(F.col(c).alias(f"in_{i}") for i, c in enumerate(names)))
    types = [f.dataType.simpleString() for f in rows.schema.fields[1:]]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in zip(names, types, strict=True)), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        weight = sent.value.dense()
        for batch in batches:
            value = score(sent.value.bias, weight, batch.column(0))
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return rows.mapInArrow(run, schema)


def labelled_rows(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """id, text and label of the labelled documents outside the held-out fold."""
    own = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).cast("int").alias("label"))
    texts = docs.where(F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), modulus) != held_out)).select(F.col("doc_id").alias("id"), "text")
    return texts.join(own, "id")
