"""What filters do to each other in every order: a packed bitmap index over filters, labels and parts.

Flags of a document are computed once, as columns. Each task packs its rows into bitsets, a bit for each document and a
bitset for each filter and label, in which a part's documents lie side by side from a byte's start. A set of filters
applied before (a prefix, in any order) leaves survivors by AND-NOT with one bitset more; popcounts, added up between
the parts' starts, give all parts' counts of a prefix and a next filter at once. Tasks send one row for each part,
prefix and filter, Spark sums them, and orders are a join of the sums with the table of all orders and steps.

The copy filter compares by the text's SHA-256: hashes are shuffled, texts are not; a hash of so many rows that there
can be but ``HOT_TEXTS`` of them is joined by broadcast.

Defined results: a null text counts as empty, a null part as ''; a null id is no smaller id and has none, and has no
labels; rows that repeat an id are documents each, and don't copy each other; an id with several labels has a label if
any of them says so; a document without labels is neither good nor toxic; an empty table gives an empty result; columns
that the operator doesn't name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut

#: Documents that one bitmap index holds.
ROWS = 1 << 20
#: Texts at most that are joined by broadcast: those with at least one row in so many of the table, and LEAST_HOT rows.
HOT_TEXTS, LEAST_HOT = 50_000, 200
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def packed_counts(parts: np.ndarray, flags: np.ndarray, filters: int) -> tuple[np.ndarray, ...]:
    """(parts, prefix, filter, and a column for each of ``_COUNTS``) of documents.

    ``parts``: a number for each document. ``flags``: a bit for each filter that it fails, then one for 'good', then one
    for 'toxic'. ``prefix`` has a bit for each filter that was applied before; filters in it are left out.
    """
    order = np.argsort(parts, kind="stable")
    names, size = np.unique(parts, return_counts=True)
    bytes_of = -(-size // 8)
    start = np.cumsum(bytes_of) - bytes_of
    place = np.repeat(start * 8 - (np.cumsum(size) - size), size) + np.arange(len(parts))
    bits = np.zeros((filters + 3, int(bytes_of.sum()) * 8), bool)
    for i in range(filters + 2):
        bits[i, place] = (flags[order] >> i) & 1
    bits[-1, place] = True
    *fails, good, toxic, every = np.packbits(bits, axis=1)

    def count(bitset: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bitset).astype(np.int64), start)

    left = [every]
    for prefix in range(1, 1 << filters):
        lowest = (prefix & -prefix).bit_length() - 1
        left.append(left[prefix & (prefix - 1)] & ~fails[lowest])
    out = []
    for f in range(filters):
        failing, alone = count(fails[f]), count(fails[f] & left[(1 << filters) - 1 - (1 << f)])
        for prefix in (p for p in range(1 << filters) if not p >> f & 1):
            gone = left[prefix] & fails[f]
            removed = count(gone)
            kept = count(left[prefix]) - removed
            out.append((names, np.full(len(names), prefix), np.full(len(names), f), kept, removed, failing - removed, alone, count(gone & good), count(gone & toxic)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _index(filters: int):
    names = ["part", "prefix", "filter", *_COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            coded = whole.column(0).combine_chunks().dictionary_encode()
            part, *columns = packed_counts(coded.indices.to_numpy(), whole.column(1).to_numpy(), filters)
            return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(part)), *map(pa.array, columns)], names=names)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                yield counted()
                held, n = [], 0
        if n:
            yield counted()

    return run


def _with_copies(rows: DataFrame) -> DataFrame:
    """The rows with ``copy``: whether a row of a smaller id has the same ``sha``; ``rows`` is a written table."""
    texts = cut(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"), "copied")
    hot = F.col("n") >= max(LEAST_HOT, -(-rows.count() // HOT_TEXTS))
    of_hot = F.broadcast(texts.where(hot).select("sha", "first_id"))
    joined = rows.join(of_hot, "sha")
    joined = joined.unionByName(rows.join(of_hot, "sha", "left_anti").join(texts.where(~hot).select("sha", "first_id"), "sha", "left"))
    return joined.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)))


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, what the step does, Shapley value.

    ``filters``: a name of one letter and a condition on the column ``text`` that holds where a document fails it (null
    counts as not failing). ``copies``: the name of a last filter, which fails documents of which a smaller id has the
    text. Counts of a step: kept, removed, redundant, unique_fails, good_lost, toxic_lost; ``shapley``: what its filter
    removes, summed over all orders.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    names = [*filters, *([copies] if copies else [])]
    if any(len(x) != 1 for x in names) or len(set(names)) < len(names) or not 1 <= len(names) <= 8:
        raise ValueError("1 to 8 filters, named by different single letters, are wanted")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    flags = F.lit(0)
    for i, fails in enumerate(filters.values()):
        flags = flags + F.when(fails, 1 << i).otherwise(0)
    sha = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)) if copies else F.lit(None).cast("binary")
    rows = cut(rows.select("doc_id", "part", flags.alias("flags"), sha.alias("sha")), "flags")
    marked = _with_copies(rows) if copies else rows.withColumn("copy", F.lit(False))
    marked = marked.select("doc_id", "part", (F.col("flags") + F.when(F.col("copy"), 1 << (len(names) - 1)).otherwise(0)).alias("flags"))

    own = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = marked.join(own.where("id is not null and (good or toxic)"), F.col("doc_id") == F.col("id"), "left")
    bit = F.col("flags") + F.when(F.col("good"), 1 << len(names)).otherwise(0) + F.when(F.col("toxic"), 1 << (len(names) + 1)).otherwise(0)

    counts = joined.select("part", bit.alias("flags")).mapInArrow(_index(len(names)), "part string, prefix long, filter long, " + ", ".join(f"{c} long" for c in _COUNTS))
    sums = counts.groupBy("part", "prefix", "filter").agg(*(F.sum(c).alias(c) for c in _COUNTS))

    orders = [
        ("".join(order), step + 1, sum(1 << names.index(x) for x in order[:step]), names.index(x)) for order in permutations(names) for step, x in enumerate(order)
    ]
    steps = spark.createDataFrame(orders, "filter_order string, step int, prefix long, filter long")
    # A prefix of s filters stands before a filter in s! (n - 1 - s)! of the orders.
    weights = [(p, factorial(p.bit_count()) * factorial(max(0, len(names) - 1 - p.bit_count()))) for p in range(1 << len(names))]
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights for x in pair)), F.col("prefix").cast("int"))
    sums = cut(sums, "sums")
    shapley = sums.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"))
    full = sums.join(F.broadcast(steps), ["prefix", "filter"]).join(shapley, ["part", "filter"])
    return full.select("part", "filter_order", "step", *_COUNTS, "shapley")


def text_filters() -> dict[str, Column]:
    """Short texts (A), repeated words (B), capitals (C) and signs (D), on a column ``text``.

    A word is a maximal run of characters that are not ASCII white space; case counts.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * capitals > 5 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
