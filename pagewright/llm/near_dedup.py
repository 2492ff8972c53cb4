"""MinHash near-dedup from bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles (64-bit hashes) and the k smallest of them, its sketch. Equal sets fall
   into one class, which goes on as one node.
2. Inverted lists: the retained values that two nodes or more share. The sketches of two sets of Jaccard similarity s
   share at least as many values as the union's k smallest hold of the intersection, a number near Binomial(k, s). So a
   linked pair shares ``need`` values or more (missed with probability below ``MISS``; sets that fit their sketch obey
   the exact bound instead), and among a node's values, rarest first, all but the last ``need - 1`` suffice to meet
   every partner. Values that many documents share come last in that order and are seldom listed at all.
3. Star pass: of the most central members of its lists (whose values occur most often in all), each node is compared
   with the one that the union sketch estimates nearest. This joins large groups of copies in a number of pairs linear
   in their size.
4. Cross pass: nodes of lists that are in several components still, and that share ``need`` values of their sketches
   with other components, are listed again, by the rarest of all their shingles, under the exact bound; a shingle that
   no other component holds counts as the node's own. Nodes carry the head of their list, the rarest ``HEAD`` values
   under which they are listed, to each value. Two nodes of different components pair if their sizes, their places at
   the value and the overlap of their heads leave room for enough overlap, and only at the first value that their heads
   share. Most loose copies of one text, which have changes of their own, fail there, in the join.
5. The union sketch's estimate filters pairs; the exact Jaccard similarity of the full sets decides, over texts in the
   star pass and over the sets that are there already in the cross pass. What many pairs need is dealt in copies, so
   that one node of many pairs is no single task.

Components spread by smallest label with pointer jumping, every round written to the shared folder.

What stays quadratic: members of one list that differ in component are compared inside the join, where a long list is
dealt in parts of ``MEMBERS``, each beside a copy of the list; and pairs whose true similarity is just below the
threshold reach the exact check. No method that loses no link is known to avoid either.

Defined results: a null text or one without words has an empty set, is linked with nothing and is its own component;
fewer words than the shingle width make one shingle; rows with equal sets are always linked; rows that repeat an id and
have words share its component, whatever their texts; a row with a null id is linked as others are, has the smallest id
of its component, or null if that has none (as for an empty set), and is not kept; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut, drop_tables, mix64, remove, text_blocks
from pagewright.llm.components import connected_components
from pagewright.llm.membership import split
from pagewright.llm.words import shingles, words

#: Values in a sketch.
SKETCH = 48
#: Probability, at most, that the lists or the estimate miss a pair exactly at the threshold.
MISS = 1e-6
#: Turns the order of unsigned 64-bit values into that of signed ones.
TOP_BIT = np.uint64(1 << 63)
#: Values that a node carries to each of its lists in the cross pass.
HEAD = 64
#: Pairs that meet one copy of a node's text, set or sketch.
PAIRS = 200
#: Members of a list in the cross pass that one part of it holds.
MEMBERS = 2_000


def needed(k: int, percent: int, miss: float = MISS) -> int:
    """The largest t such that Binomial(k, percent / 100) is below t with a probability of ``miss`` at most."""
    p, below = percent / 100, 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if below > miss:
            return t
    return k


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each row."""
    for lo, hi, raw, at in text_blocks(column):
        flat, first = shingles(words(raw, at), width)
        for r in range(hi - lo):
            yield lo + r, np.unique(flat[first[r] : first[r + 1]])


def signatures(docs: DataFrame, width: int, k: int | None) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits that name the set), sketch (its k smallest hashes; None: all), text_hash.

    ``docs`` has doc_id, text and text_hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int32)
            names = np.zeros((2, batch.num_rows), np.uint64)
            kept, sizes = [], np.zeros(batch.num_rows + 1, np.int32)
            for r, values in _sets(batch.column(1), width):
                n[r] = len(values)
                names[0, r] = mix64(values).sum(dtype=np.uint64)
                names[1, r] = mix64(values ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
                # The top bit is flipped, so that Spark's signed order is the order in which the smallest were taken.
                kept.append((values[:k] ^ TOP_BIT).view(np.int64))
                sizes[r + 1] = len(kept[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
            s1, s2 = (pa.array(mix64(x + n.astype(np.uint64)).view(np.int64)) for x in names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), s1, s2, lists, batch.column(2)], names=["doc_id", "n", "s1", "s2", "sketch", "text_hash"])

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, sketch array<long>, text_hash long")


def _row() -> Column:
    """Which row a set is read from: its id (0 if null) and its text's hash, as rows that repeat an id can differ in text."""
    return F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")


def _same_id(marked: DataFrame, wanted: bool) -> DataFrame:
    """Links (a, b) between the sets of rows that repeat an id: each with the id's smallest; none if not ``wanted``."""
    sets = marked.where("n > 0 and doc_id is not null" if wanted else "false").select("doc_id", "s1")
    several = cut(sets.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("hi")).where("a < hi").select("doc_id", "a"), "several")
    out = cut(sets.join(several, "doc_id").where("a <> s1").select("a", F.col("s1").alias("b")).distinct(), "links")
    remove(marked.sparkSession, several)
    return out


def _list_values(nodes: DataFrame, k: int | None, need: int, percent: int) -> DataFrame:
    """(v, node, n, place, central): the values under which each node is listed.

    place: how many of the node's values come before v, rarest first; central: how often its values occur in all. With
    ``k`` None the sketches are full sets of nodes with a label; values of one label alone are not listed, and head (the
    first values of the list), last (the head's last, as ordered), after (values after the head) and label come along.
    """
    whole = k is None
    more = ["label"] if whole else []
    posting = nodes.select("node", "n", *more, F.explode("sketch").alias("v"))
    if whole:
        shared = posting.groupBy("v").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v", "c")
    else:
        shared = posting.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    rare_first = posting.join(shared, "v").groupBy("node", "n", *more).agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("values"), F.sum("c").alias("central"))
    exact = F.ceil(F.col("n") * percent / 100).cast("int")
    size, least = (F.col("n"), exact) if whole else (F.least("n", F.lit(k)), F.least(exact, F.lit(need)))
    # Values that no other node has are rarest, and meet nobody.
    alone = size - F.size("values")
    rows = rare_first.withColumn("alone", alone).withColumn("take", size - least + 1 - F.col("alone")).where("take > 0")
    if whole:
        head = F.slice("values", 1, F.least("take", F.lit(HEAD)))
        rows = rows.withColumn("last", F.element_at(head, -1)).withColumn("head", F.transform(head, lambda x: x.v))
        rows = rows.withColumn("after", F.col("n") - F.col("alone") - F.size("head"))
        more = ["label", "head", "last", "after"]
    listed = rows.select("node", "n", "alone", "central", *more, F.posexplode(F.slice("values", 1, F.col("take"))).alias("i", "x"))
    return listed.select(F.col("x.v").alias("v"), "node", "n", (F.col("alone") + F.col("i")).alias("place"), "central", *more)


def _met(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one list, of full sets, with different labels, that can have enough overlap.

    Values come in one order, rarest first. All that two sets share from a common value on comes after it in both. Of
    the two heads, let x's end first: what the sets share up to there is in both heads, and beyond it are ``after`` of
    x's values.
    """
    names = ("node", "n", "place", "label", "head", "last", "after")
    left, right = (listed.select("v", *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "ab")
    # |A and B| >= p / (100 + p) * (|A| + |B|) is the threshold on |A and B| / |A or B|.
    least = percent * (F.col("n_a") + F.col("n_b"))
    by_place = (100 + percent) * F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= least
    after = F.when(F.col("last_a") <= F.col("last_b"), F.col("after_a")).otherwise(F.col("after_b"))
    common = F.array_intersect("head_a", "head_b")
    by_heads = (100 + percent) * (F.size(common) + after) >= least
    first = lambda v: F.coalesce(F.get(common, F.lit(0)) == v, F.lit(True))
    left, many = _dealt(left, "v", "node_a", MEMBERS)
    right = _copies(right, "v", many)
    met = left.join(right, (left["v"] == right["v"]) & (left["part"] == right["part"]) & (left["label_a"] < right["label_b"]) & by_place & by_heads & first(left["v"]))
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _dealt(pairs: DataFrame, key: str, other: str, size: int = PAIRS) -> tuple[DataFrame, DataFrame]:
    """The pairs with ``part``, and (key, parts) of the keys that have more than one part of about ``size`` pairs.

    These are few and written, so that Spark knows their size before it joins them and doesn't shuffle the rest for them.
    """
    many = cut(pairs.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias("parts")).where("parts > 1"), "many")
    dealt = pairs.join(many, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")), F.lit(0)).cast("int"))
    return dealt.drop("parts"), many


def _copies(table: DataFrame, key: str, many: DataFrame) -> DataFrame:
    """A row of ``table`` for each part of its key."""
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    return table.join(many, key, "left").withColumn("part", F.explode(parts)).drop("parts")


def _with_both(pairs: DataFrame, a: tuple[str, DataFrame], b: tuple[str, DataFrame]) -> DataFrame:
    """Pairs with the columns that the tables have for their keys; ``pairs`` is a written table."""
    (of_a, left), (of_b, right) = a, b
    dealt, many = _dealt(pairs, of_b, of_a)
    return dealt.join(left, of_a).join(_copies(right, of_b, many), [of_b, "part"]).drop("part")


def _estimate(na: Column, sa: Column, nb: Column, sb: Column, k: int, need: int, percent: int) -> tuple[Column, Column]:
    """The share of the union's sketch that both sets have, and whether it is enough; sa and sb are sketches."""
    every = F.array_union(sa, sb)
    union = F.slice(F.array_sort(every), 1, k)
    common = F.size(F.array_intersect(F.array_intersect(sa, sb), union))
    whole = (na <= k) & (nb <= k) & (F.size(every) <= k)
    return common / F.size(union), F.when(whole, 100 * common >= percent * F.size(union)).otherwise(common >= need)


def _estimated(pairs: DataFrame, nodes: DataFrame, k: int, need: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch holds enough of the intersection, with that share as ``near``."""
    side = nodes.select("node", "n", "rep", "sketch")
    left, right = (_with_key(side, pairs.select(F.col(c).alias("node"))) for c in "ab")
    both = _with_both(pairs, ("a", left.toDF("a", "na", "ra", "sa")), ("b", right.toDF("b", "nb", "rb", "sb")))
    near, enough = _estimate(*(F.col(c) for c in ("na", "sa", "nb", "sb")), k, need, percent)
    return both.where(enough).select("a", "b", "ra", "rb", near.alias("near"))


def _with_key(nodes: DataFrame, keys: DataFrame) -> DataFrame:
    """The nodes that may be among the ``keys``, of a written table: those that surely aren't are not shuffled."""
    return split(nodes, ["node"], keys)[1]


def _still_open(open_nodes: DataFrame, nodes: DataFrame, k: int, need: int, percent: int) -> DataFrame:
    """(node, label) of the open nodes that share enough values of their sketches with other components to be linked."""
    sketches = _with_key(nodes.select("node", "n", "sketch"), open_nodes.select("node"))
    posting = open_nodes.join(sketches, "node").select("node", "label", "n", F.explode("sketch").alias("v"))
    mixed = posting.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
    shared = posting.join(mixed, "v").groupBy("node", "label", "n").agg(F.count("*").alias("c"))
    return shared.where(F.col("c") >= F.least(F.lit(need), F.ceil(F.col("n") * percent / 100))).select("node", "label")


def _verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ra and rb are the rows (see ``_row``) that have the sets."""
    keys = cut(pairs.select(F.col("ra").alias("row")).union(pairs.select(F.col("rb").alias("row"))).distinct(), "rows")
    _, found = split(rows, ["row"], keys)
    # Rows of one id and hash have one text, of which each task sends one. The keys are distinct; Spark would push a
    # semi-join below the filter, and shuffle all texts.
    texts = found.join(keys, "row").groupBy("row").agg(F.first("text").alias("t"))
    joined = _with_both(pairs.select("a", "b", "ra", "rb"), ("ra", texts.toDF("ra", "ta")), ("rb", texts.toDF("rb", "tb")))
    joined = joined.select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for (r, x), (_, y) in zip(_sets(batch.column(2), width), _sets(batch.column(3), width), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[r] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long")


def _verified_sets(pairs: DataFrame, sets: DataFrame, k: int, need: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose union sketch, and then whose full sets (node, sketch) are similar enough."""
    side = sets.select("node", "sketch")
    both = _with_both(pairs, ("a", side.toDF("a", "sa")), ("b", side.toDF("b", "sb")))
    _, enough = _estimate(F.size("sa"), F.slice("sa", 1, k), F.size("sb"), F.slice("sb", 1, k), k, need, percent)
    common = F.size(F.array_intersect("sa", "sb"))
    alike = (common > 0) & ((100 + percent) * common >= percent * (F.size("sa") + F.size("sb")))
    return both.where(enough).where(alike).select("a", "b")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    ``hashed`` adds text_hash, xxhash64 of the text, which tells apart rows that repeat an id with another text; such
    rows are then linked by their texts alone.

    Two documents are linked if 100 * |A and B| >= ``percent`` * |A or B| over their sets of ``width``-word shingles.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    need = needed(k, percent)
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    by_row = docs.withColumn("row", _row())
    marked = cut(signatures(docs, width, k), "signatures")
    classes = marked.where("n > 0").groupBy("s1", "s2", "n")
    nodes = cut(classes.agg(F.min("doc_id").alias("smallest"), F.min(_row()).alias("rep"), F.first("sketch").alias("sketch")).withColumnRenamed("s1", "node"), "classes")
    same_id = _same_id(marked, not hashed)
    listed = cut(_list_values(nodes, k, need, percent), "lists")

    central = listed.groupBy("v").agg(F.max_by("node", F.struct("central", "node")).alias("b"))
    seen = cut(listed.join(central, "v").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "seen")
    nearest_of = lambda pairs: pairs.groupBy("a").agg(F.max_by(F.struct("b", "ra", "rb"), "near").alias("x")).select("a", "x.*")
    star = cut(nearest_of(_estimated(seen, nodes, k, need, percent)), "star")
    of_star = cut(_verified(star, by_row, width, percent), "links")
    label = connected_components(of_star.unionByName(same_id))

    member = listed.join(label, "node", "left").select("v", "node", F.coalesce("label", "node").alias("label"))
    mixed = member.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("v")
    in_mixed = cut(member.join(mixed, "v").select("node", "label").distinct(), "mixed")
    open_nodes = cut(_still_open(in_mixed, nodes, k, need, percent), "open")
    reps = cut(open_nodes.join(nodes.select("node", "rep"), "node").select(F.col("rep").alias("row")), "reps")
    full = signatures(split(by_row, ["row"], reps)[1], width, None).withColumnRenamed("s1", "node")
    full = cut(full.join(open_nodes, "node").select("node", "n", "sketch", "label").dropDuplicates(["node"]), "sets")
    crossed = cut(_list_values(full, None, need, percent), "crossed")
    paired = cut(_met(crossed, percent), "paired")
    across = cut(_verified_sets(paired, full, k, need, percent), "links")
    final = connected_components(of_star.unionByName(across).unionByName(same_id))
    remove(spark, listed, seen, star, of_star, same_id, label, in_mixed, open_nodes, reps, full, crossed, paired, across)

    reached = nodes.select("node", "s2", "n", "smallest").join(final, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = reached.groupBy("label").agg(F.min("smallest").alias("component_id"))
    by_set = reached.join(smallest, "label").select(F.col("node").alias("s1"), "s2", "n", "component_id")
    # s1 is null for empty sets, which no class has: they are their own component.
    named = ["text_hash"] if hashed else []
    rows = marked.select("doc_id", *named, "n", F.when(F.col("n") > 0, F.col("s1")).alias("s1"), "s2").join(by_set, ["s1", "s2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
        *named,
    )
