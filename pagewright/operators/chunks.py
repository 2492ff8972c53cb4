"""Chunks of blocks: greedy grouping by size or heading, assembly, overlap. All native columns.

Blocks come as an array of structs (block_type, text, markdown, structural_hash) in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.resolution import let
from pagewright.functions.text import tokens_about

SEPARATOR = "\n\n---\n\n"


def validate(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be 1 or more, and overlap from 0 to below size")


def groups(blocks: Column, size: int, at_headings: bool = False) -> Column:
    """Consecutive groups of blocks as structs (first, count, start, length), by one fold.

    A group takes blocks while their texts, with two characters between, fit ``size``; a longer block stands alone.
    ``start`` is the offset of the group's text if groups are joined by two characters.
    """
    kind = "array<struct<first:int,count:int,start:int,length:int>>"
    zero = F.struct(F.lit(0).alias("first"), F.lit(0).alias("count"), F.lit(0).alias("start"), F.lit(-2).alias("length"), F.array().cast(kind).alias("done"))

    def current(s: Column) -> Column:
        return F.array(F.struct(s["first"].alias("first"), s["count"].alias("count"), s["start"].alias("start"), s["length"].alias("length")))

    def step(s: Column, b: Column) -> Column:
        grown = s["length"] + 2 + F.length(b["text"])
        full = grown > size
        if at_headings:
            full = full | (b["block_type"] == "heading")
        new = (s["count"] > 0) & full
        return F.struct(
            F.when(new, s["first"] + s["count"]).otherwise(s["first"]).alias("first"),
            F.when(new, 1).otherwise(s["count"] + 1).alias("count"),
            F.when(new, s["start"] + s["length"] + 2).otherwise(s["start"]).alias("start"),
            F.when(new, F.length(b["text"])).otherwise(grown).alias("length"),
            F.when(new, F.concat(s["done"], current(s))).otherwise(s["done"]).alias("done"),
        )

    return F.aggregate(blocks, zero, step, lambda s: F.when(s["count"] > 0, F.concat(s["done"], current(s))).otherwise(s["done"]))


def chunk_array(blocks: Column, strategy: str = "size", size: int = 2000, overlap: int = 0) -> Column:
    """The chunks of an array of blocks, in order, as structs: see ``chunks``."""
    validate(size, overlap)

    def joined(group: Column, field: str, between: str) -> Column:
        return F.array_join(F.transform(F.slice(blocks, group["first"] + 1, group["count"]), lambda b: b[field]), between)

    def one(prefix: Column, g: Column, n: Column) -> Column:
        return F.struct(
            n.alias("n"),
            F.concat(F.lit("chunk-"), (n + 1).cast("string")).alias("chunk_id"),
            F.concat(prefix, joined(g, "text", "\n\n")).alias("text"),
            F.concat(prefix, joined(g, "markdown", "\n\n")).alias("markdown"),
            F.sequence(g["first"], g["first"] + g["count"] - 1).alias("block_ordinals"),
            F.concat(F.lit("sha256:"), F.sha2(joined(g, "structural_hash", "\n"), 256)).alias("structural_hash"),
            F.greatest(F.lit(0), g["start"] - F.length(prefix)).alias("char_start"),
            (g["start"] + g["length"]).alias("char_end"),
            tokens_about(F.concat(prefix, joined(g, "text", "\n\n"))).alias("token_estimate"),
        )

    def all_of(found: Column) -> Column:
        def prefix(n: Column) -> Column:
            if not overlap:
                return F.lit("")
            before = joined(F.element_at(found, F.greatest(n, F.lit(1))), "text", "\n\n")
            return F.when(n > 0, F.concat(F.substring(before, -overlap, overlap), F.lit(SEPARATOR))).otherwise("")

        return F.transform(found, lambda g, n: let(prefix(n), lambda p: one(p, g, n)))

    return let(groups(blocks, size, strategy == "heading"), all_of)


def chunks(rows: DataFrame, strategy: str = "size", size: int = 2000, overlap: int = 0, blocks: str = "blocks") -> DataFrame:
    """One row per chunk: the other columns, n, chunk_id, text, markdown, block_ordinals, structural_hash, char_start, char_end, token_estimate.

    ``strategy`` is none (no rows), size or heading. With ``overlap`` a chunk begins with the last characters of the
    chunk before, as it was without overlap, and a separator; its start shifts by that length.
    """
    rest = [c for c in rows.columns if c != blocks]
    if strategy == "none":
        rows = rows.where(F.lit(False))
    return rows.select(*rest, F.explode(chunk_array(F.col(blocks), strategy, size, overlap)).alias("_c")).select(*rest, "_c.*")


def line_blocks(text: Column) -> Column:
    """Blocks of a plain text: its non-empty lines, a short one first counting as a heading."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.transform(
        lines,
        lambda x: F.struct(
            F.when((F.length(x) <= 40), "heading").otherwise("paragraph").alias("block_type"), x.alias("text"), x.alias("markdown"), F.sha2(x, 256).alias("structural_hash")
        ),
    )
