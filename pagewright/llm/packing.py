"""Best-fit packing planned over a histogram of lengths.

Documents are tokenized where they lie and cut into pieces; what is kept of a piece is a row of a few numbers, written
to the shared folder. The counts of pieces by length (at most as many as a sequence has tokens) come to the driver,
where best-fit decreasing runs over counts: a step places a whole run of equal pieces into a run of equally filled
sequences. The plan's size follows the sequence length, not the documents. Pieces take their planned slots by a join on
their rank within their length; ranks are counted in salted groups of about ``GROUP_ROWS`` rows, so that a length that
most pieces have is no single task.

The vocabulary is applied to distinct words (runs between ASCII white space, which the vocabulary's splitting never
crosses); each worker keeps a bounded table of words it has met. A special token's name in a text becomes that token, as
the tokenizers library has it.

Defined results: a null text counts as empty; an empty text is one piece of one token, the end id; a document with a
null id is packed like any other; rows that repeat an id are packed each; an empty table gives an empty result; columns
other than id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut, text_blocks, worker_table

TOKENS = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Rows that one group counts ranks over, about.
GROUP_ROWS = 1_000_000
#: Distinct words a worker keeps before it starts anew.
KEPT_WORDS = 400_000
#: Bytes of text whose new words are encoded together.
BLOCK_BYTES = 4 << 20
#: Distinct words joined for one call of the tokenizer.
_CALL = 1000


#: How the vocabulary's own splitting cuts words of lower-case printable ASCII, one on each line; fixed, as it must
#: agree with it.
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+|\n")
_PRINTABLE = re.compile(rb"[!-~]+")


def _gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``first``, one after another."""
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0)
    where += np.repeat(first - (ends - size), size)
    return flat[where]


class Numbered(dict):
    """Numbers of distinct keys in the order in which they were met; those met lately are in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def of(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class WordIds:
    """The ids of distinct words: those of word w are flat[first[w] : first[w] + size[w]] after ``encode``.

    Words of printable ASCII are cut into pieces, and each distinct piece is encoded once: such need no normalising.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.of_pieces = Tokenizer(self.tokenizer.model)
        self.of_pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        known = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(known.values()) + 1, bool)
        self.ends[[i for token, i in known.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.pieces = Numbered(), Numbered()
        none, one = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.flat, self.first, self.size = np.zeros(0, np.uint32), none, none
        # The end of a line is the first piece and has no ids.
        self.pieces[b"\n"] = 0
        self.piece_flat, self.piece_first, self.piece_size = np.zeros(0, np.uint32), one, one

    def _by_pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of printable ASCII, one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        place = self.pieces.of(_PIECE.findall(b"\n".join(words)))
        new, self.pieces.new = self.pieces.new, []
        flats = [np.zeros(0, np.uint32)]
        for i in range(0, len(new), _CALL):
            text = b" ".join(new[i : i + _CALL]).decode("ascii")
            flats.append(np.array(self.of_pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        ids = np.concatenate(flats)
        stop = np.flatnonzero(self.ends[ids]) + 1
        start = np.append(0, stop)[: len(stop)]
        self.piece_first = np.append(self.piece_first, len(self.piece_flat) + start)
        self.piece_size, self.piece_flat = np.append(self.piece_size, stop - start), np.append(self.piece_flat, ids)
        size = self.piece_size[place]
        begins = np.append(0, np.flatnonzero(place == 0))
        return _gathered(self.piece_flat, self.piece_first[place], size), np.add.reduceat(size, begins)

    def _whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words. They are joined by a special token; those with a piece of such a token go alone."""
        flats, sizes = [np.zeros(0, np.uint32)], []
        for i in range(0, len(words), _CALL):
            some = [x.decode("utf-8") for x in words[i : i + _CALL]]
            if any("<|" in x for x in some):
                lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
                flats.append(np.array([x for ids in lists for x in ids], np.uint32))
                sizes += [len(x) for x in lists]
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
            sizes += np.diff(ends, prepend=-1).__sub__(1).tolist()
            flats.append(ids[ids != self.mark_id])
        return np.concatenate(flats), np.array(sizes, np.int64)

    def encode(self) -> None:
        """Ids of the words met since the last call."""
        new, self.words.new = self.words.new, []
        plain = np.fromiter((_PRINTABLE.fullmatch(x) is not None and b"<|" not in x for x in new), bool, len(new))
        first, size, flat = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), [self.flat]
        at = len(self.flat)
        for chosen, ids_of in ((plain, self._by_pieces), (~plain, self._whole)):
            ids, size[chosen] = ids_of(list(compress(new, chosen)))
            first[chosen] = at + np.cumsum(size[chosen]) - size[chosen]
            flat.append(ids)
            at += len(ids)
        self.flat, self.first, self.size = np.concatenate(flat), np.append(self.first, first), np.append(self.size, size)


def _table(vocabulary: str) -> WordIds:
    """The worker's table."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_table(f"words of {vocabulary}", lambda: WordIds(vocabulary))


def token_ids(column: pa.Array, vocabulary: str = VOCABULARY) -> Iterator[np.ndarray]:
    """The ids of each text, and the end id."""
    table = _table(vocabulary)
    for lo, hi, raw, at in text_blocks(column, BLOCK_BYTES):
        if len(table.words) > KEPT_WORDS:
            table.clear()
        places = []
        for r in range(hi - lo):
            # The vocabulary lower-cases; doing so for ASCII here makes fewer distinct words. The names of its special
            # tokens, which it finds in any text, count as they are written.
            own = raw[at[r] : at[r + 1]].tobytes()
            places.append(table.words.of(own.lower().split() if b"<|" not in own else [x if b"<|" in x else x.lower() for x in own.split()]))
        if table.words.new:
            table.encode()
        for place in places:
            yield np.append(_gathered(table.flat, table.first[place], table.size[place]), np.uint32(END_ID))


def pieces(docs: DataFrame, tokens: int = TOKENS, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of at most ``tokens`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, length, check = [], [], [], []
            for r, ids in enumerate(token_ids(batch.column(1), vocabulary)):
                ids = ids.astype("<u4", copy=False)
                for p, lo in enumerate(range(0, len(ids), tokens)):
                    part = ids[lo : lo + tokens]
                    row.append(r)
                    piece.append(p)
                    length.append(len(part))
                    check.append(zlib.crc32(part))
            number = np.array(piece, np.int32)
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(number), pa.array(number.astype(np.int64) * tokens), pa.array(length, pa.int64()), pa.array(check, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], tokens: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, end rank, first sequence, offset) of each run of slots.

    The pieces of a length, by rank, fill the fullest open sequences that have room; a run of sequences with the same
    room is one entry. New sequences take as many of a length as fit.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, number)
    rooms = 0  # bit r is set if open_runs[r] has entries
    sequences = 0

    def put(room: int, first: int, number: int) -> None:
        nonlocal rooms
        if room and number:
            open_runs.setdefault(room, []).append((first, number))
            rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                first, number = open_runs[room].pop()
                if not open_runs[room]:
                    rooms &= ~(1 << room)
                used = min(left, number)
                slots.append((length, rank, rank + used, first, tokens - room))
                put(room, first + used, number - used)
                put(room - length, first, used)
                rank, left = rank + used, left - used
                continue
            each = min(tokens // length, left)
            number = left // each
            for i in range(each):
                slots.append((length, rank, rank + number, sequences, i * length))
                rank += number
            put(tokens - each * length, sequences, number)
            sequences, left = sequences + number, left - each * number
    return slots


def pack(docs: DataFrame, tokens: int = TOKENS, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    arrow_rows(spark)
    # Rows that repeat an id, or have none, are told apart by a number that is written with them.
    rows = cut(pieces(docs, tokens, vocabulary, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, math.ceil(rows.count() / GROUP_ROWS))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)).cast("int"))
    counts = cut(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan(histogram, tokens) or [(0, 0, 0, 0, 0)], "length long, lo long, hi long, first long, offset long")

    running = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "row")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")
