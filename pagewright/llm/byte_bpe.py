"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is split by the vocabulary's pattern; distinct pieces are encoded once for each worker, which keeps a bounded
table of them. New pieces are sorted into matrices by length (powers of two), one row for each. In a round every row
finds its leftmost pair of minimum rank, by a hashed lookup of all neighbouring pairs at once, merges it, and is
compacted; rows without a pair are finished and leave. A piece beyond ``LONGEST`` bytes, of which a matrix would need
as many rounds, is merged with a heap instead, by the same rule.

Defined results: a null text counts as empty and has no tokens; every text decodes to its own bytes; rows with a null or
repeated id are encoded each; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONGEST = 512
#: Distinct pieces a worker keeps before it starts anew.
KEPT_PIECES = 300_000
#: Characters of text whose pieces are held at once.
SLICE = 2 << 20
_NONE = np.int32(0x7FFFFFFF)
_HASH = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    def __init__(self, name: str) -> None:
        with open(public_tokenizers.path(name), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {r: t for t, r in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._fill(pairs)

    def _fill(self, pairs: dict[int, int]) -> None:
        """An open-addressing table at a load of an eighth at most; ``probes``: the longest way to an entry."""
        bits = max(10, (8 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.keys[slot] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            here = free & first
            self.keys[slot[here]], self.values[slot[here]] = keys[here], values[here]
            keys, values, slot = keys[~here], values[~here], (slot[~here] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _HASH) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, or _NONE."""
        keys = a.astype(np.int64) << 32 | b
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], _NONE)
        open_at = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.probes - 1):
            if not len(open_at):
                break
            slot_at = (slot[open_at] + 1) & self.mask
            slot[open_at], held = slot_at, self.keys[slot_at]
            found = held == keys[open_at]
            out[open_at[found]] = self.values[slot_at[found]]
            open_at = open_at[~found & (held != -1)]
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            known = self.ranks.get(piece)
            if known is not None:
                out[i] = np.array([known], np.int32)
            elif len(piece) > LONGEST:
                out[i] = self._merge_long(piece)
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            step = max(1, (1 << 20) // width)
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                for i, ids in zip(own, self._merge([pieces[i] for i in own], width), strict=True):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        size = np.array([len(x) for x in pieces])
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.byte_id[raw], -1)
        ranks = np.full(ids.shape, _NONE, np.int32)
        inside = column[:-1] + 1 < size[:, None]
        ranks[:, :-1][inside] = self.rank(ids[:, :-1][inside], ids[:, 1:][inside])
        live, done = np.arange(len(pieces)), [None] * len(pieces)
        while len(live):
            at = ranks.argmin(axis=1)  # the first of equal ranks is the leftmost
            row = np.arange(len(live))
            best = ranks[row, at]
            ended = best == _NONE
            if ended.any():
                for k in np.flatnonzero(ended):
                    done[live[k]] = ids[k, : size[k]].copy()
                keep = ~ended
                live, ids, ranks, size, at, best = live[keep], ids[keep], ranks[keep], size[keep], at[keep], best[keep]
                row = np.arange(len(live))
                if not len(live):
                    break
            ids[row, at] = best
            # Columns right of the merged pair move left by one.
            moved = np.minimum(column + (column > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, moved, 1), np.take_along_axis(ranks, moved, 1)
            size = size - 1
            last = row, size
            ids[last], ranks[last] = -1, _NONE
            ranks[row, size - 1] = _NONE
            right = at + 1 < size
            ranks[row[right], at[right]] = self.rank(ids[row[right], at[right]], ids[row[right], at[right] + 1])
            left = at > 0
            ranks[row[left], at[left] - 1] = self.rank(ids[row[left], at[left] - 1], ids[row[left], at[left]])
        return done

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = [int(x) for x in self.byte_id[np.frombuffer(piece, np.uint8)]]
        after, before = [*range(1, len(ids)), -1], list(range(-1, len(ids) - 1))
        waiting = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(waiting)
        while waiting:
            rank, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := self.pairs.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(waiting, (r, left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], np.int32)


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    return Vocabulary(name)


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(public_tokenizers.PATTERN)


class PieceIds:
    """Ids, as decimal text, and decoded bytes of distinct pieces."""

    def __init__(self, name: str) -> None:
        self.vocabulary, self.text, self.decoded = vocabulary(name), {}, {}

    def learn(self, pieces: set[str]) -> None:
        token, order = self.vocabulary.token, list(pieces)
        for piece, ids in zip(order, self.vocabulary.encode([x.encode("utf-8") for x in order]), strict=True):
            ids = ids.tolist()
            self.text[piece] = ",".join(map(str, ids))
            self.decoded[piece] = b"".join([token[i] for i in ids])


@lru_cache(maxsize=1)
def _held(name: str) -> list[PieceIds]:
    return [PieceIds(name)]


def _parts(texts: list[str | None]) -> Iterator[list[tuple[int, str | None]]]:
    """(row, text) in groups of about SLICE characters, so that many new pieces are encoded together."""
    group, size = [], 0
    for r, text in enumerate(texts):
        group.append((r, text))
        size += len(text or "")
        if size >= SLICE:
            yield group
            group, size = [], 0
    if group:
        yield group


def _pieces(text: str) -> Iterator[list[str]]:
    """The pattern's matches, in lists of bounded length."""
    if len(text) <= SLICE:
        yield _splitter().findall(text)
        return
    found = (m.group() for m in _splitter().finditer(text))
    while some := list(islice(found, SLICE // 4)):
        yield some


def digests(column: pa.Array, name: str = VOCABULARY) -> tuple[list[int], list[str], list[str]]:
    """Number of tokens, sha256 of the decimal ids and sha256 of the decoded bytes of each text."""
    held = _held(name)
    n = len(column)
    count, of_ids, of_bytes = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
    texts = column.to_pylist()

    def take(lists: list[tuple[int, list[str]]]) -> None:
        if len(held[0].text) > KEPT_PIECES:
            held[0] = PieceIds(name)
        known, decoded = held[0].text, held[0].decoded
        new = set().union(*(pieces for _, pieces in lists)).difference(known)
        if new:
            held[0].learn(new)
        for r, pieces in lists:
            if pieces:
                line = ",".join(map(known.__getitem__, pieces)).encode()
                of_ids[r].update(b"," + line if count[r] else line)
                of_bytes[r].update(b"".join(map(decoded.__getitem__, pieces)))
                count[r] += line.count(b",") + 1

    for group in _parts(texts):
        short = [(r, text) for r, text in group if len(text or "") <= SLICE]
        take([(r, pieces) for r, text in short for pieces in _pieces(text or "")])
        for r, text in group:
            if len(text or "") > SLICE:
                for pieces in _pieces(text):
                    take([(r, pieces)])
    return count, [x.hexdigest() for x in of_ids], [x.hexdigest() for x in of_bytes]


def encode_digests(docs: DataFrame, name: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, of_ids, of_bytes = digests(batch.column(1), name)
            columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, name: str = VOCABULARY, text_col: str = "text") -> DataFrame:
    """The input with a column ``ids``, an array of the text's token ids."""
    arrow_rows(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        def ids(text):
            pieces = [x.encode("utf-8") for x in _splitter().findall(text or "")]
            return np.concatenate([np.zeros(0, np.int32), *vocabulary(name).encode(pieces)])

        return texts.map(ids, na_action=None)

    return docs.withColumn("ids", ids_of(F.col(text_col)))


def decode(docs: DataFrame, name: str = VOCABULARY, ids_col: str = "ids") -> DataFrame:
    """The input with a column ``decoded``, the bytes of the ids in ``ids_col`` (null for null)."""

    @F.pandas_udf("binary")
    def bytes_of(lists):
        token = vocabulary(name).token
        return lists.map(lambda ids: None if ids is None else b"".join([token[int(i)] for i in ids]))

    return docs.withColumn("decoded", bytes_of(F.col(ids_col)))
