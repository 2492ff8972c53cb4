"""Exact top-k search by distributed histogram selection.

All rows are scored against a bounded chunk of queries at a time, in blocks (one matrix product each), without keeping
scores. Each pass adds up, for every query, a histogram of the scores inside the query's current range; the bin that
holds the k-th best value is the next range, until it is one value. Ties at that value are located in the same way by
row id. A last pass keeps the rows above each query's cut, which are k at most. A task sends, for each query, only the
topmost bins that hold k of its own rows; a lower bin of that task can't hold the k-th value.

Defined results: a vector that is null, empty or has a null or non-finite component takes no part, neither does one with
a null id as a candidate's tie can't be broken; vectors of different length don't meet; rows that have the query's own
id are not its candidates; a query id that repeats is searched once, with its smallest vector; a query with fewer than
k candidates gets them all; a score beyond 64 bits counts, and is returned, as the nearest one that fits (so does a
component, after scaling); an empty table gives an empty result; columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut

#: Queries that are broadcast and scored together, about.
CHUNK = 4096
BINS = 256
#: Candidates scored by one matrix product.
BLOCK = 1024
_EXACT, _MOST = 1 << 53, (1 << 63) - 1


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    first = np.cumsum(size) - size
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[first[rows][:, None] + np.arange(n)]


class Queries:
    """A chunk of queries with, for each, the range (lo, hi) that holds its k-th value and how many it lacks there.

    ``at`` is None while scores are searched, then the score at which ids are. Ids are searched negated, so that in
    either case larger is better.
    """

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], bound: float, k: int) -> None:
        self.ids, self.k = ids, k
        self.by_size = {n: np.array([i for i, v in enumerate(vectors) if len(v) == n]) for n in {len(v) for v in vectors}}
        self.matrix = {n: np.array([vectors[i] for i in own]) for n, own in self.by_size.items()}
        # No inner product is larger than the lengths' product, nor is a sum on the way to it.
        reach = [(math.isqrt(int(np.dot(v.astype(object), v))) + 1) * (int(bound * 1.001) + 1) for v in vectors]
        most = max(reach, default=0)
        self.kind = np.float64 if most < _EXACT else np.int64 if most < 1 << 63 else object
        reach = np.array([min(x, _MOST) for x in reach], np.int64)
        self.lo, self.hi = -reach, reach
        self.need = np.full(len(ids), k)
        self.cut, self.cut_id = np.full(len(ids), -_MOST - 1), np.full(len(ids), _MOST)
        self.by_id = np.zeros(len(ids), bool)
        self.open = np.ones(len(ids), bool)

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query places, candidate ids, scores, taking part) of each block of pairs."""
        ids = batch.column(0).to_numpy()
        for rows, matrix in _matrices(batch.column(1)):
            own = self.by_size.get(matrix.shape[1])
            if own is None:
                continue
            for lo in range(0, len(rows), BLOCK):
                some, left = rows[lo : lo + BLOCK], self.matrix[matrix.shape[1]]
                right = matrix[lo : lo + BLOCK]
                value = left.astype(self.kind) @ right.T.astype(self.kind)
                if self.kind is object:
                    value = np.clip(value, -_MOST, _MOST)
                yield own, ids[some], value.astype(np.int64), self.ids[own][:, None] != ids[some]

    def widths(self) -> np.ndarray:
        """Of a bin, for each query; a range may be wider than a signed value."""
        span = self.hi.view(np.uint64) - self.lo.view(np.uint64)
        return span // np.uint64(BINS) + np.uint64(1)

    def histogram(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = self.widths()
        total = np.zeros((len(self.ids), BINS), np.int64)
        for batch in batches:
            for own, ids, value, part in self.scores(batch):
                ids_here = self.by_id[own]
                key = value
                if ids_here.any():
                    part = part & (~ids_here[:, None] | (value == self.cut[own][:, None]))
                    key = np.where(ids_here[:, None], ~ids, value)
                part = part & self.open[own][:, None] & (key >= self.lo[own][:, None]) & (key <= self.hi[own][:, None])
                q, c = np.nonzero(part)
                bins = ((key[q, c].view(np.uint64) - self.lo[own[q]].view(np.uint64)) // width[own[q]]).astype(np.int64)
                total += np.bincount(own[q] * BINS + bins, minlength=total.size).reshape(total.shape)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < self.k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[q, b])], names=["q", "b", "n"])

    def narrow(self, rows: list) -> None:
        """Take the bin of the k-th value as the next range of each query; ``rows``: (q, b, n), summed over the tasks."""
        width = self.widths()
        bins: dict[int, list[tuple[int, int]]] = {}
        for q, b, n in rows:
            bins.setdefault(q, []).append((b, n))
        for q in np.flatnonzero(self.open):
            for b, n in sorted(bins.get(q, []), reverse=True):
                if n < self.need[q]:
                    self.need[q] -= n
                    continue
                first = int(self.lo[q]) + b * int(width[q])
                self.lo[q], self.hi[q] = first, min(int(self.hi[q]), first + int(width[q]) - 1)
                if self.lo[q] == self.hi[q]:
                    self._found(q, n)
                break
            else:  # fewer than k candidates: all of them
                self.open[q] = False

    def _found(self, q: int, n: int) -> None:
        if self.by_id[q]:
            self.cut_id[q], self.open[q] = ~self.lo[q], False
            return
        self.cut[q] = self.lo[q]
        if n == self.need[q]:
            self.open[q] = False
        else:
            self.by_id[q] = True
            self.lo[q], self.hi[q] = self.id_range

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids, value, part in self.scores(batch):
                cut = self.cut[own][:, None]
                q, c = np.nonzero(part & ((value > cut) | (value == cut) & (ids <= self.cut_id[own][:, None])))
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[own[q]]), pa.array(ids[c]), pa.array(value[q, c])], names=["query_id", "vec_id", "score"])


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component x; null if the vector is null or a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows for each row that ``is_query`` holds for."""
    spark = vectors.sparkSession
    arrow_rows(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col), scale).alias("v"), is_query.alias("is_query"))
    rows = cut(rows.where("vec_id is not null and v is not null"), "vectors")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    seen = rows.agg(F.max(length).alias("bound"), F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"), F.count(F.when(F.col("is_query"), 1)).alias("n")).head()
    queries = rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks = max(1, math.ceil(seen["n"] / CHUNK))
    candidates, found = rows.select("vec_id", "v"), []
    for i in range(chunks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == i).orderBy("vec_id").collect()
        if not own:
            continue
        state = Queries(np.array([r["vec_id"] for r in own]), [np.array(r["v"], np.int64) for r in own], seen["bound"], k)
        state.id_range = ~seen["hi"], ~seen["lo"]
        while state.open.any():
            sent = spark.sparkContext.broadcast(state)
            part = candidates.mapInArrow(lambda batches, sent=sent: sent.value.histogram(batches), "q int, b int, n long")
            summed = part.groupBy("q", "b").agg(F.sum("n").alias("n"))
            top = Window.partitionBy("q").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
            summed = summed.withColumn("above", F.coalesce(F.sum("n").over(top), F.lit(0))).where(F.col("above") < k)
            state.narrow([(r["q"], r["b"], r["n"]) for r in summed.select("q", "b", "n").collect()])
        sent = spark.sparkContext.broadcast(state)
        best = candidates.mapInArrow(lambda batches, sent=sent: sent.value.best(batches), "query_id long, vec_id long, score long")
        found.append(best if chunks == 1 else cut(best, "best"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
