"""Exact dedup: group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Texts are hashed where they lie; of all rows only hashes and ids are shuffled or written. Hashes that occur more than
once make a filter of bounded size (see ``membership``), and only texts that pass it are grouped, by hash *and text*, so
Spark compares the bytes. A group of copies reaches that shuffle as one row for each map task, however large it is. From
there on the texts under one hash are told apart by the sha256 of the text that was compared. Rows that don't pass the
filter are alone and join nothing; groups of so many rows that there can be but ``HOT_GROUPS`` of them are joined by
broadcast, the others by hash.

Defined results: a null text counts as empty; empty texts are equal to each other; a null id is never kept by
``exact_dedup`` while the group has another id, and is returned with the group's id; rows that repeat an id and text are
counted each; an empty table gives an empty result. ``exact_dedup`` doesn't read columns other than id and text, so
their names can't clash; ``distinct_texts`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import cut
from pagewright.llm.membership import split

#: Groups at most that are joined by broadcast: those with at least one row in so many of the table, and LEAST_HOT rows.
HOT_GROUPS, LEAST_HOT = 50_000, 200


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _repeated(hashes: DataFrame) -> DataFrame:
    return cut(hashes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep``: the group's smallest ('min') or largest ('max') id stays. ``hash_of`` maps the text to the grouping hash
    (tests pass a weak one to force collisions).
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sha = F.unhex(F.sha2(F.encode("text", "UTF-8"), 256))
    light = cut(rows.select("doc_id", hash_of(F.col("text")).alias("h"), sha.alias("sha")), "hashes")
    repeated = _repeated(light)

    _, texts = split(rows.withColumn("h", hash_of(F.col("text"))), ["h"], repeated)
    groups = texts.groupBy("h", "text").agg(F.count("*").alias("n"), pick("doc_id").alias("keep_id"))
    groups = cut(groups.select("h", sha.alias("sha"), "n", "keep_id"), "groups")
    hot = F.col("n") >= max(LEAST_HOT, -(-light.count() // HOT_GROUPS))

    alone, grouped = split(light, ["h"], repeated)
    of_hot = F.broadcast(groups.where(hot))
    joined = grouped.join(of_hot, ["h", "sha"])
    joined = joined.unionByName(grouped.join(of_hot, ["h", "sha"], "left_anti").join(groups.where(~hot), ["h", "sha"]))
    every = joined.unionByName(alone.withColumn("n", F.lit(1).cast("long")).withColumn("keep_id", F.col("doc_id")))
    return every.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, of which one stays for each text: that of the smallest id.

    A null id comes after the others; of rows that repeat the id and text, the first in the order of their other columns
    as JSON stays.
    """
    rows = docs.withColumn("__hash", content_hash(F.coalesce(F.col(text_col), F.lit(""))))
    hashes = _repeated(rows.select(F.col("__hash").alias("h")))
    alone, repeated = split(rows, ["__hash"], hashes.toDF("__hash"))
    others = F.struct(*(F.col(c) for c in docs.columns if c != text_col), F.col(text_col).isNull().alias("__null"))
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.to_json(others))
    texts = repeated.groupBy("__hash", F.coalesce(F.col(text_col), F.lit("")).alias("__text")).agg(F.min_by(others, order).alias("x"))
    text = F.when(~F.col("x.__null"), F.col("__text")).alias(text_col)
    kept = texts.select(*(text if c == text_col else F.col(f"x.{c}").alias(c) for c in docs.columns))
    return alone.select(docs.columns).unionByName(kept)
