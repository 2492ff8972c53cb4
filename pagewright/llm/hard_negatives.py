"""Hard negatives by exact search: an orthogonal PCA rotation, partial products, bounds on the rest, integer products.

Vectors are turned by the eigenvectors of their second moments, leading ones first, which leaves inner products as they
are. Of a block of anchors and candidates the products of the leading components are added up, part by part; what the
other components can add is at most the product of the residual norms. A pair that can't reach what its anchor still
looks for, with ``SLACK`` for rounding, is discarded; survivors get their integer product, which alone decides.

Anchors are broadcast in chunks of at most ``CHUNK_BYTES``, and each chunk passes over the candidates twice: for the
positives, then for the negatives between the bounds that the positives set. A task keeps its best few for each anchor
(or positive), so it sends a bounded number of rows for each; Spark ranks these.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part;
vectors of different length don't meet; rows that have the anchor's own id are neither its positives nor its negatives;
an anchor id that repeats is mined once, with its smallest vector and then label; other rows that repeat an id count
each; a component or score beyond 64 bits counts as the nearest one that fits; an empty table gives an empty result;
columns other than id, vector and label are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut
from pagewright.llm.topk_search import _matrices, scaled

#: Bytes of anchors that are broadcast together; two passes over the candidates serve so many.
CHUNK_BYTES = 32 << 20
#: Candidates and anchors of one block.
BLOCK, ANCHORS = 2048, 1024
#: Pairs of which the vectors are gathered together.
PAIRS = 1 << 15
#: Of the product of two lengths: more than what rounding can do to a rotated product of doubles.
SLACK = 1e-9
#: A part's products are taken of whole blocks while more than so many pairs are left, in one, then pair by pair.
DENSE = 1 / 16
_EXACT, _MOST = 1 << 53, (1 << 63) - 1


class Best:
    """The k best (score, id) of each key, larger scores and then smaller ids first, of what ``add`` gets."""

    def __init__(self, keys: int, k: int) -> None:
        self.k = k
        self.score = np.full((keys, k), -_MOST - 1, np.int64)
        self.id = np.zeros((keys, k), np.int64)
        self.filled = np.zeros(keys, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(key):
            self.held.append((key, score, ids))
            self.n += len(key)
        if self.n > 4 * self.k * len(self.filled) + PAIRS:
            self.settle()

    def settle(self) -> None:
        if not self.n:
            return
        key, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.n = [], 0
        touched = np.unique(key)
        old, place = np.nonzero(np.arange(self.k) < self.filled[touched][:, None])
        old = touched[old]
        key, score, ids = np.concatenate([key, old]), np.concatenate([score, self.score[old, place]]), np.concatenate([ids, self.id[old, place]])
        order = np.lexsort((ids, ~score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        some = rank < self.k
        self.score[key[some], rank[some]], self.id[key[some], rank[some]] = score[some], ids[some]
        self.filled[key[first]] = np.minimum(np.diff(np.r_[first, len(key)]), self.k)

    def least(self) -> np.ndarray:
        """A score that is needed to get in: the k-th one so far."""
        return np.where(self.filled == self.k, self.score[:, -1], -_MOST - 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.settle()
        key, place = np.nonzero(np.arange(self.k) < self.filled[:, None])
        return key, self.score[key, place], self.id[key, place]


def _parts(n: int) -> list[int]:
    """Ends of the parts of n components: an eighth, a quarter, a half, all."""
    return sorted({max(1, n // 8), max(1, n // 4), max(1, n // 2), n})


def _turned(matrix: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated vectors, and their residual norms after each part, a column each."""
    y = matrix.astype(np.float64) @ rotation
    tail = np.cumsum((y * y)[:, ::-1], axis=1)[:, ::-1]
    rest = [np.sqrt(tail[:, e]) if e < y.shape[1] else np.zeros(len(y)) for e in _parts(y.shape[1])]
    return y, np.column_stack(rest)


class Anchors:
    """A chunk of anchors of any lengths. ``low``, ``high``: of each anchor's positives, the bounds of negatives."""

    def __init__(self, rows: list, rotations: dict[int, np.ndarray], bound: float) -> None:
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.rotations = rotations
        sizes = np.array([len(r["v"]) for r in rows])
        self.places = {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}
        self.matrix = {n: np.array([rows[i]["v"] for i in own], np.int64) for n, own in self.places.items()}
        self.turned = {n: _turned(m, rotations[n]) for n, m in self.matrix.items()}
        longest = max((float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max()) for m in self.matrix.values()), default=0.0)
        reach = longest * bound * 1.001 + 1
        self.kind = np.float64 if reach < _EXACT else np.int64 if reach < 1 << 62 else object
        self.low = self.high = None

    def products(self, n: int, rows: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Integer products of pairs of the anchors' and the candidates' vectors."""
        if self.kind is np.float64:  # whole numbers below 2^53, and so are all sums on the way
            return np.einsum("ij,ij->i", self.matrix[n][rows].astype(np.float64), right.astype(np.float64)).astype(np.int64)
        value = (self.matrix[n][rows].astype(self.kind) * right.astype(self.kind)).sum(axis=1)
        return np.clip(value, -_MOST, _MOST).astype(np.int64) if self.kind is object else value

    def survivors(self, batch: pa.RecordBatch, wanted, least: np.ndarray, most: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, candidate ids, scores) of pairs that may score from ``least`` to ``most``, by anchor."""
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for rows, matrix in _matrices(batch.column(2)):
            n = matrix.shape[1]
            for a in range(0, len(self.places.get(n, ())), ANCHORS):
                at = slice(a, a + ANCHORS)
                own = self.places[n][at]
                ya, ra = self.turned[n][0][at], self.turned[n][1][at]
                low, high = least[own].astype(np.float64), None if most is None else most[own].astype(np.float64)
                for c in range(0, len(rows), BLOCK):
                    some, right = rows[c : c + BLOCK], matrix[c : c + BLOCK]
                    part = wanted(self.labels[own][:, None], labels[some]) & (self.ids[own][:, None] != ids[some])
                    q, r = self._pairs(ya, ra, *_turned(right, self.rotations[n]), part, low, high)
                    for i in range(0, len(q), PAIRS):
                        qs, rs = q[i : i + PAIRS], r[i : i + PAIRS]
                        yield own[qs], ids[some[rs]], self.products(n, a + qs, right[rs])

    @staticmethod
    def _pairs(ya, ra, yc, rc, part, low, high) -> tuple[np.ndarray, np.ndarray]:
        slack = SLACK * np.sqrt((ya * ya).sum(axis=1))[:, None] * np.sqrt((yc * yc).sum(axis=1)) + 1
        total, begin, ends = np.zeros(part.shape), 0, _parts(ya.shape[1])
        for stage, end in enumerate(ends):
            total += ya[:, begin:end] @ yc[:, begin:end].T
            rest = ra[:, stage][:, None] * rc[:, stage] + slack
            part = part & (total + rest >= low[:, None])
            if high is not None:
                part &= total - rest <= high[:, None]
            begin = end
            if np.count_nonzero(part) < DENSE * part.size:
                break
        q, r = np.nonzero(part)
        value = total[q, r]
        for stage in range(ends.index(begin) + 1, len(ends)):
            end, keep = ends[stage], []
            for i in range(0, len(q), PAIRS):
                s = slice(i, i + PAIRS)
                value[s] += np.einsum("ij,ij->i", ya[q[s], begin:end], yc[r[s], begin:end])
                rest = ra[q[s], stage] * rc[r[s], stage] + slack[q[s], r[s]]
                keep.append((value[s] + rest >= low[q[s]]) & (True if high is None else value[s] - rest <= high[q[s]]))
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            q, r, value, begin = q[keep], r[keep], value[keep], end
        return q, r

    def positives(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        best = Best(len(self.ids), k)
        for batch in batches:
            for own, ids, score in self.survivors(batch, np.equal, best.least(), None):
                best.add(own, score, ids)
            best.settle()
        key, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(score), pa.array(ids)], names=["a", "score", "id"])

    def negatives(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """Keys are anchor times positives of an anchor, plus the positive's place."""
        n = self.low.shape[1]
        best = Best(self.low.size, k)
        most = self.high.max(axis=1)
        for batch in batches:
            least = np.maximum(self.low, best.least().reshape(self.low.shape)).min(axis=1)
            for own, ids, score in self.survivors(batch, np.not_equal, least, most):
                for p in range(n):
                    fine = (score >= self.low[own, p]) & (score <= self.high[own, p])
                    best.add(own[fine] * n + p, score[fine], ids[fine])
            best.settle()
        key, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array((key // n).astype(np.int32)), pa.array((key % n).astype(np.int32)), pa.array(score), pa.array(ids)], names=["a", "p", "score", "id"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, matrix in _matrices(batch.column(0)):
            x = matrix.astype(np.float64)
            x /= max(1.0, np.abs(x).max(initial=1.0))  # a scale for each block keeps the sums finite; it weighs rows alone
            held[x.shape[1]] = held.get(x.shape[1], 0.0) + x.T @ x
    for n, m in held.items():
        i, j = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n * n, n, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())], names=["n", "i", "j", "s"])


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Of each length, the eigenvectors of the second moments of all vectors ``v``, those of large eigenvalues first.

    Tasks send a matrix for each length that they see. Any orthogonal matrix gives the same results.
    """
    parts = vectors.select("v").mapInArrow(_moments, "n int, i int, j int, s double")
    sums = parts.groupBy("n", "i", "j").agg(F.sum("s").alias("s"))
    moment: dict[int, np.ndarray] = {}
    for r in sums.collect():
        moment.setdefault(r["n"], np.zeros((r["n"], r["n"])))[r["i"], r["j"]] = r["s"]
    return {n: np.ascontiguousarray(np.linalg.eigh((m + m.T) / 2)[1][:, ::-1]) for n, m in moment.items()}


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole numbers x with low * score <= 100 * x <= high * score."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    An anchor's positives are its ``positives`` best other rows of its label; for each of them the ``negatives`` best
    rows of another label follow whose score lies between ``low`` and ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    arrow_rows(spark)
    label = (F.col("label") if label is None else label).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), scaled(F.col(vector_col), scale).alias("v"), is_anchor.alias("is_anchor"))
    rows = cut(rows.where("vec_id is not null and label is not null and v is not null"), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    seen = rows.agg(F.max(length).alias("bound"), F.max(F.size("v")).alias("width"), F.count(F.when(F.col("is_anchor"), 1)).alias("n")).head()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    if not seen["n"]:
        return spark.createDataFrame([], schema)
    turn = rotations(rows)
    anchors = rows.where("is_anchor").groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.v", "x.label")
    chunks = math.ceil(seen["n"] * (seen["width"] * 16 + 16 * (positives + positives * negatives)) / CHUNK_BYTES)
    candidates, found = rows.select("vec_id", "label", "v"), []
    for i in range(chunks):
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == i).orderBy("vec_id").collect()
        if not own:
            continue
        chunk = Anchors(own, turn, seen["bound"])
        sent = spark.sparkContext.broadcast(chunk)
        part = candidates.mapInArrow(lambda batches, sent=sent: sent.value.positives(batches, positives), "a int, score long, id long")
        order = Window.partitionBy("a").orderBy(F.desc("score"), "id")
        best = cut(part.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives), "positives")
        chunk.low, chunk.high = np.full((len(own), positives), _MOST), np.full((len(own), positives), -_MOST - 1)
        for r in best.select("a", "p", "score").collect():
            chunk.low[r["a"], r["p"] - 1], chunk.high[r["a"], r["p"] - 1] = _bounds(r["score"], low, high)
        sent = spark.sparkContext.broadcast(chunk)
        part = candidates.mapInArrow(lambda batches, sent=sent: sent.value.negatives(batches, negatives), "a int, p int, score long, id long")
        order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id")
        part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumn("p", F.col("p") + 1)
        part = part.withColumnsRenamed({"score": "negative_score", "id": "negative_id"}).join(best.withColumnsRenamed({"score": "positive_score", "id": "positive_id"}), ["a", "p"])
        known = spark.createDataFrame([(j, r["vec_id"]) for j, r in enumerate(own)], "a int, anchor_id long")
        part = part.join(F.broadcast(known), "a").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("p").alias("positive_rank"))
        found.append(part if chunks == 1 else cut(part, "mined"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every
