"""The language of a text by rank-order profiles: how far out of place its most frequent trigrams are.

A profile has the ``TOP`` trigrams of a language's texts in order of frequency. A text's own trigrams are ranked alike;
one that a profile holds is out of place by the difference of ranks, one that it lacks by ``TOP``. The language of the
least sum wins, ties by name. Trigrams are of letters in lower case, words apart by one blank; they are counted in
Arrow batches, ranks and sums are columns.

Defined results: a text without letters, or null, has no language; a row with a null language teaches nothing; an id that
repeats is a text of each row's own; with no profiles, no text has a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trigrams in a profile, of a language and of a text.
TOP = 300
#: Characters whose trigrams are counted together.
CHARACTERS = 1 << 20


def letters(text: Column) -> Column:
    """Words of letters in lower case, a blank before and after each; null without letters."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    return F.when(bare != "", F.concat(F.lit(" "), bare, F.lit(" ")))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different trigrams of a text as numbers, which are in the order of the texts they stand for, and their counts."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:], return_counts=True)


def _named(grams: np.ndarray) -> list[str]:
    mask = np.uint64((1 << 21) - 1)
    codes = np.stack([grams >> np.uint64(42), (grams >> np.uint64(21)) & mask, grams & mask], axis=1).astype("<u4")
    whole = codes.tobytes().decode("utf-32-le")
    return [whole[i : i + 3] for i in range(0, len(whole), 3)]


def top_trigrams(text: Column, top: int = TOP) -> Column:
    """The ``top`` most frequent trigrams of a text of ``letters``, most frequent and then smallest first."""

    @F.pandas_udf("array<string>")
    def ranked(texts: pd.Series) -> pd.Series:
        def of(t: str) -> list[str]:
            grams, counts = _counted(t)
            return _named(grams[np.lexsort((grams, -counts))[:top]])

        return texts.map(of, na_action="ignore")

    return ranked(text)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): counts of trigrams, added up over a batch."""
    for batch in batches:
        held: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
        for lang, texts in held.items():
            ends = np.cumsum([len(t) for t in texts])
            lo = 0
            while lo < len(texts):  # some CHARACTERS of text at a time, or one text
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHARACTERS, side="right")))
                # Texts begin and end with a blank; trigrams across two of them have two blanks in a row, and no text has.
                grams, counts = _counted("".join(texts[lo:hi]))
                two = (grams >> np.uint64(21)) == np.uint64((32 << 21) | 32)
                two |= (grams & np.uint64((1 << 42) - 1)) == np.uint64((32 << 21) | 32)
                grams, counts = grams[~two], counts[~two]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(_named(grams), pa.string()), pa.array(counts)], names=["lang", "gram", "n"])
                lo = hi


def profiles(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, place): each language's ``top`` trigrams, over all texts that have a language; place from 0.

    Counts are added up, a megabyte of text at a time, before they are shuffled. ``top`` rows of each language, so the table is small.
    """
    taught = texts.select(F.col(lang_col).alias("lang"), letters(F.col(text_col)).alias("t")).where("lang is not null and t is not null")
    counts = taught.mapInArrow(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < top).select("lang", "gram", "place")


def detected(texts: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """id, detected (null if none), distance, agreement (0 to 1, the share of places that fit): a row for each text.

    A text's few hundred ranked trigrams meet the profiles, which Spark broadcasts, and their sums are added up by text
    and language before they are shuffled.
    """
    rows = texts.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), top_trigrams(letters(F.col(text_col)), top).alias("own"))
    ranked = rows.select("row", F.size("own").alias("n"), F.posexplode("own").alias("place_here", "gram"))
    fits = ranked.join(F.broadcast(known), "gram").groupBy("row", "n", "lang").agg(F.sum(top - F.abs(F.col("place") - F.col("place_here"))).alias("fit"))
    best = fits.groupBy("row", "n").agg(F.min(F.struct((-F.col("fit")).alias("less"), "lang")).alias("x"))
    first = best.select("row", "n", (-F.col("x.less")).alias("fit"), "x.lang")
    found = first.withColumn("distance", (top * F.col("n") - F.col("fit")).cast("bigint"))
    out = rows.select("id", "row").join(found, "row", "left")
    return out.select(F.col("id").alias(id_col), F.col("lang").alias("detected"), "distance", F.round(F.col("fit") / (top * F.col("n")), 6).alias("agreement"))


def with_language(declared: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Metadata with ``language``: the declared one, or else the detected one; ``language_source`` and its confidence."""
    both = declared.join(found.select(id_col, "detected"), id_col, "left")
    own = F.col("language").isNotNull()
    return both.select(
        *(c for c in declared.columns if c != "language"), F.coalesce("language", "detected").alias("language"),
        F.when(own, "declared").when(F.col("detected").isNotNull(), "detected").alias("language_source"), F.when(own, 1.0).when(F.col("detected").isNotNull(), 0.6).alias("language_confidence"),
    )
