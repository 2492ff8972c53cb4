"""Which rows can have a key that a table of keys holds: a filter of bounded size, in DataFrame functions alone.

The keys set three bits each in a 64-bit word of a table of words, which is gathered on the executors in rows of ``BLOCK``
words and broadcast. Rows whose bits aren't all set have none of the keys; of the others about one in five hundred is there
by chance at ``BITS_PER_KEY`` bits a key. The table grows with the keys up to a ``SHARE`` of the smaller of driver's and
executor's memory (and ``MOST_BITS``): 16 MB of 1 GB, which is four million keys at full precision; 512 MB of 32 GB, 134
million. Beyond that more rows pass by chance, 4 % at 8 bits a key and 16 % at 4, up to all. The filter spares a
shuffle of rows and decides nothing: what passes is joined by its key afterwards.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.base import cut

BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 32
#: Words in a row of the broadcast table.
BLOCK = 1024
#: Of the memory, what the table may take.
SHARE = 1 / 64


def _memory(spark: SparkSession) -> int:
    """Bytes of the driver's or an executor's heap, whichever is smaller; 1 GB, as Spark has it, where they aren't set."""
    sizes = []
    for name in ("spark.driver.memory", "spark.executor.memory"):
        number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(name, "1g").strip().lower()).groups()
        sizes.append(int(number) << {"": 20, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit])
    return min(sizes)


def filter_bits(keys: int, memory: int) -> int:
    """Bits of the table, a power of two."""
    most = min(MOST_BITS, 1 << (int(memory * SHARE * 8).bit_length() - 1))
    return max(LEAST_BITS, min(most, 1 << (BITS_PER_KEY * keys).bit_length()))


def _word_and_mask(key: Column, bits: int) -> tuple[Column, Column]:
    h = F.xxhash64(F.lit(7), key)
    at = [F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)) for n in (40, 46, 52)]
    mask = F.lit(0).cast("long")
    for x in at:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int")))
    return F.pmod(h, F.lit(bits // 64)), mask


def split(rows: DataFrame, on: list[str], keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that have none of the ``keys`` for sure, rows that may have one); ``keys`` is a written table of ``on``.

    A row with a null in ``on`` may have a key. Join what may have one by an inner or a left join: Spark pushes semi-joins
    and anti-joins below the filter, so that all rows are shuffled.
    """
    spark = rows.sparkSession
    bits = filter_bits(keys.count(), _memory(spark))
    word, mask = _word_and_mask(F.struct(*on), bits)
    # Every word is there, those without a key as 0, so that a block's words are an array.
    every = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("m"))
    words = every.unionAll(keys.select(word.alias("w"), mask.alias("m"))).groupBy("w").agg(F.bit_or("m").alias("m"))
    blocks = words.groupBy(F.floor(F.col("w") / BLOCK).alias("__block")).agg(F.sort_array(F.collect_list(F.struct("w", "m"))).alias("x"))
    blocks = cut(blocks.select("__block", F.transform("x", lambda y: y.m).alias("__held")), "filter")
    marked = rows.withColumn("__block", F.floor(word / BLOCK)).join(F.broadcast(blocks), "__block")
    maybe = F.get("__held", (word % BLOCK).cast("int")).bitwiseAND(mask) == mask
    return marked.where(~maybe).drop("__block", "__held"), marked.where(maybe).drop("__block", "__held")
