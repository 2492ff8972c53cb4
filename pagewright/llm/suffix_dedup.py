"""Removal of bytes that a smaller document has: suffix buckets, sorted one at a time, with a difference cover for ties.

Every window of ``width`` bytes is a suffix to that depth. Equal windows have the same smallest hash among their
``GRAM``-byte strings, so that hash deals windows to buckets; neighbours in a text mostly share it and travel as one
stretch of text, about four bytes for each window. A bucket thus has all windows that can be equal, with their bytes.

Most stretches have a hash that no other document has, and stay: blocks first send 32 bits of each of their different
hashes, and get back a bit for each, whether another block has the same. Only stretches with such a hash, or one that two
documents of their block share, send their text.

A task takes one bucket at a time. It sorts the bucket's suffixes by a fingerprint of their window; those that stand alone
are done. Positions of the others' text in a difference cover (``COVER`` modulo ``PERIOD``) are ranked once, exactly, by
the bytes that follow. Of two suffixes that tie, some shift below ``PERIOD`` brings both to ranked positions: a few bytes
at both ends and one comparison of ranks settle the tie, however long it is, so no two windows count as equal by a hash.
Memory holds one bucket's text and a few numbers for each of its windows.

The replies, stretches of windows that a smaller document has, go back to the block that the text came from. Blocks are
written once, so that replies and text meet by the block's number if tasks are repeated. Equal stretches of one block
are sent once, that of the smallest id; the others' answer is known there.

Defined results: a null text counts as empty; a null id is never smaller, and such rows keep all; rows that repeat an id
don't take each other's bytes; texts shorter than ``width`` keep all; a document's own repeats stay; an empty table gives
an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.base import arrow_rows, cut, mix64, remove, utf8

#: Bytes of text in a block (a longer text is a block of its own), in a bucket, and looked at together.
BLOCK_BYTES, BUCKET_BYTES, SLICE = 4 << 20, 16 << 20, 1 << 18
GRAM = 16
#: Differences of these, modulo PERIOD, are all numbers below it.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Longer stretches are sent without a look for equal ones in their block.
LONGEST = 128
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: The shift that brings positions of two residues into the cover.
SHIFT = np.array([[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)])


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each position, as a big-endian number; zeros follow the end."""
    held = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, ">u8", buffer=held, strides=(1,))


def _stretches(raw: np.ndarray, at: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, smallest hash) of maximal stretches of neighbours that share it, of ``known`` documents."""
    n, grams = len(raw), width - GRAM + 1
    fine = known & (np.diff(at) >= width)
    change = np.zeros(n + 1, np.int8)
    change[at[:-1][fine]] = 1
    change[at[1:][fine] - width + 1] -= 1
    inside = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    words = np.ndarray(n + 1, "<u8", buffer=np.concatenate([raw, np.zeros(8, np.uint8)]), strides=(1,))
    starts, values, ends = [], [], []
    for lo in range(0, max(0, n - width + 1), SLICE):
        size = min(SLICE, n - width + 1 - lo)
        ok = inside[lo : lo + size]
        if not ok.any():
            continue
        m = size + grams - 1
        least = words[lo : lo + m] * _C[0]
        least += words[lo + 8 : lo + 8 + m] * _C[1]
        least ^= least >> np.uint64(32)
        least *= _C[2]
        step = 1
        while 2 * step <= grams:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[:size], least[grams - step : grams - step + size])
        new = np.r_[True, least[1:] != least[:-1]]
        begins = np.flatnonzero(ok & (new | ~np.r_[False, ok[:-1]]))
        stops = np.flatnonzero(ok & np.r_[new[1:] | ~ok[1:], True]) + 1
        starts.append(begins + lo)
        ends.append(stops + lo)
        values.append(least[begins])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends) - start, np.concatenate(values)


def _known_here(raw: np.ndarray, start: np.ndarray, size: np.ndarray, value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of each stretch, whether an equal one of a smaller id stands in the same block."""
    out = np.zeros(len(start), bool)
    own = np.flatnonzero(size <= LONGEST)
    if len(own) < 2:
        return out
    words = _words(raw)
    key = mix64((value[own] ^ words[start[own]] * _C[0]) + words[start[own] + size[own] - 8] * _C[1] + size[own].astype(np.uint64))
    order = np.lexsort((ids[own], key))
    own, key = own[order], key[order]
    first = np.r_[True, key[1:] != key[:-1]]
    lead = own[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]
    maybe = ~first & (ids[own] > ids[lead]) & (size[own] == size[lead])
    a, b = own[maybe], lead[maybe]
    equal = np.ones(len(a), bool)
    for j in range(0, LONGEST, 8):
        some = equal & (size[a] > j)
        if not some.any():
            break
        place = np.minimum(j, size[a[some]] - 8)
        equal[some] = words[start[a[some]] + place] == words[start[b[some]] + place]
    out[a[equal]] = True
    return out


def _packed(*columns: np.ndarray, text: np.ndarray = np.zeros(0, np.uint8)) -> bytes:
    """Whole numbers, columns of one length, as differences, byte planes apart, and a text, compressed."""
    planes = [np.diff(c.astype(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(columns[0])], np.int64).tobytes() + b"".join(planes) + text.tobytes())


def _unpacked(payload: bytes, columns: int) -> tuple[np.ndarray, ...]:
    """The columns of a payload, and its text."""
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8)
    size = 8 * int(whole[:8].view(np.int64)[0])
    out = [np.cumsum(np.ascontiguousarray(whole[8 + i * size : 8 + (i + 1) * size].reshape(8, -1).T).view(np.int64).ravel()) for i in range(columns)]
    return (*out, whole[8 + columns * size :])


BLOCK_ROW = "block string, ids array<long>, ends array<long>, n_bytes long, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in blocks of about BLOCK_BYTES: ids, where each one's bytes end, all bytes, compressed."""
    pack = zstandard.ZstdCompressor(level=3)
    ids: list[pa.Array] = []
    sizes: list[np.ndarray] = []
    data: list[np.ndarray] = []
    held = 0

    def block() -> pa.RecordBatch:
        ends = np.cumsum(np.concatenate(sizes))
        whole = np.concatenate(data)
        return pa.RecordBatch.from_pylist([{"block": uuid.uuid4().hex, "ids": pa.concat_arrays(ids).to_pylist(), "ends": ends.tolist(), "n_bytes": len(whole), "data": pack.compress(whole.tobytes())}], schema=_BLOCK_ARROW)

    for batch in batches:
        raw, at = utf8(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES - held, side="right")) - 1)
            if held and at[hi] - at[lo] + held > BLOCK_BYTES:
                yield block()
                ids, sizes, data, held = [], [], [], 0
                continue
            ids.append(batch.column(0).slice(lo, hi - lo))
            sizes.append(np.diff(at[lo : hi + 1]))
            data.append(raw[at[lo] : at[hi]].copy())
            held += int(at[hi] - at[lo])
            lo = hi
            if held >= BLOCK_BYTES:
                yield block()
                ids, sizes, data, held = [], [], [], 0
    if ids:
        yield block()


_BLOCK_ARROW = pa.schema([("block", pa.string()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("data", pa.binary())])


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets, ids with 0 for null, whether there is an id) of a block's row."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8)
    ids = row["ids"]
    return raw, np.r_[0, np.array(row["ends"], np.int64)], np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids], bool)


class _Names:
    """The different hashes of a block's stretches, in the order in which they are sent."""

    def __init__(self, value: np.ndarray, buckets: int) -> None:
        hashes, self.of = np.unique(mix64(value), return_inverse=True)
        bucket = ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.bucket, self.short = bucket[order], (hashes[order] >> np.uint64(32)).astype(np.uint32)
        self.of = self.place[self.of]
        self.edges = np.r_[np.flatnonzero(np.r_[True, np.diff(self.bucket) != 0]), len(order)] if len(order) else np.zeros(1, np.int64)


def _sent(buckets: int, width: int):
    """Blocks to (bucket, block, payload): 32 bits of each hash that a stretch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw, at, _, known = _read(row)
                names = _Names(_stretches(raw, at, known, width)[2], buckets)
                cuts = list(zip(names.edges, names.edges[1:], strict=False))
                columns = [pa.array([int(names.bucket[a]) for a, _ in cuts], pa.int64()), pa.array([row["block"]] * len(cuts), pa.string()), pa.array([names.short[a:b].tobytes() for a, b in cuts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "payload"])

    return run


def _seen(key: tuple, rows: pa.Table) -> pa.Table:
    """(block, bucket, bits): of each hash that a block sent, in its order, whether a second one is equal."""
    sent = [np.frombuffer(p, np.uint32) for p in rows["payload"].to_pylist()]
    every = np.concatenate(sent)
    ordered = np.sort(every)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    found = np.zeros(len(every), bool)
    if len(twice):
        found = twice[np.minimum(np.searchsorted(twice, every), len(twice) - 1)] == every
    bits = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum([len(x) for x in sent])[:-1])]
    return pa.table({"block": rows["block"].cast(pa.string()), "bucket": rows["bucket"], "bits": pa.array(bits, pa.binary())})


def _shared(names: _Names, ids: np.ndarray, replies: list[dict]) -> np.ndarray:
    """Of each stretch, whether another block, or another document of its own, may have its hash."""
    n = len(names.place)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, names.of, ids)
    np.maximum.at(high, names.of, ids)
    bits = {r["bucket"]: np.frombuffer(r["bits"], np.uint8) for r in replies or ()}
    parts = [np.unpackbits(bits[int(names.bucket[a])], count=b - a) for a, b in zip(names.edges, names.edges[1:], strict=False)]
    return ((low != high) | (np.concatenate(parts) > 0 if parts else False))[names.of]


def _dealt(buckets: int, width: int):
    """Blocks and replies to (bucket, block, found, payload): stretches with text, or, if ``found``, those known already."""
    names = ["bucket", "block", "found", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw, at, ids, known = _read(row)
                start, count, value = _stretches(raw, at, known, width)
                own = ids[np.searchsorted(at, start, side="right") - 1]
                sent = _Names(value, buckets)
                some = _shared(sent, own, row["seen"])
                start, count, value, own, bucket = start[some], count[some], value[some], own[some], sent.bucket[sent.of[some]]
                size = count + width - 1
                here = _known_here(raw, start, size, value, own)
                out = []
                if here.any():
                    out.append((int(bucket[0]), True, _packed(start[here], count[here])))
                kept = np.flatnonzero(~here)
                kept = kept[np.argsort(bucket[kept], kind="stable")]
                ends = np.cumsum(size[kept])
                lo = 0
                while lo < len(kept):
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, side="right")))
                    some = kept[lo:hi]
                    length = size[some]
                    to = np.cumsum(length)
                    data = raw[np.repeat(start[some] - (to - length), length) + np.arange(to[-1])]
                    edges = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[some]) != 0]), len(some)]
                    for a, b in zip(edges, edges[1:], strict=False):
                        part = some[a:b]
                        out.append((int(bucket[part[0]]), False, _packed(start[part], count[part], own[part], text=data[to[a] - length[a] : to[b - 1]])))
                    lo = hi
                for j in range(0, len(out), 64):
                    b, f, p = zip(*out[j : j + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([row["block"]] * len(b)), pa.array(f), pa.array(p, pa.binary())], names=names)

    return run


def _ranks(words: np.ndarray, places: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Of each of ``places``, the rank of the ``depth`` bytes that follow, equal ones the same, in an array by position."""
    steps = [*range(0, depth - 8, 8), depth - 8]
    order = np.lexsort([words[places + s] for s in reversed(steps)])
    sorted_places = places[order]
    new = np.zeros(len(order), bool)
    for s in steps:
        w = words[sorted_places + s]
        new[1:] |= w[1:] != w[:-1]
    out = np.full(n, -1, np.int32)
    out[sorted_places] = np.cumsum(new)
    return out


def repeated_windows(text: np.ndarray, first: np.ndarray, count: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """Of each window of the stretches of ``text`` that begin at ``first``, whether one of a smaller id is equal.

    A stretch has ``count`` windows, one at each position from its first, and all their bytes.
    """
    n = int(count.sum())
    marked = np.zeros(n, bool)
    if n < 2:
        return marked
    stretch = np.repeat(np.arange(len(count)), count)
    place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(n)
    words = np.ascontiguousarray(_words(text), np.uint64)

    pairs = words[:-8] * _C[0] + words[8:] * _C[1]
    print_ = pairs[place] * _C[2]
    for s in range(16, width - 16, 16):
        print_ = (print_ ^ (print_ >> np.uint64(29))) * _C[3] + pairs[place + s]
    print_ = mix64(print_ + pairs[place + width - 16] * _C[4])
    del pairs
    bits = np.uint64(n.bit_length())
    key = np.sort((print_ >> bits << bits) | np.arange(n, dtype=np.uint64))
    del print_
    own = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = (key[1:] >> bits) == (key[:-1] >> bits)
    del key
    tied = np.r_[False, same] | np.r_[same, False]
    own, first_of = own[tied], ~np.r_[False, same][tied]
    if not len(own):
        return marked
    at = place[own]

    # Positions of the cover that a shift below PERIOD may lead to.
    near = np.zeros(len(text), bool)
    near[at] = True
    for s in (1, 2, 4, PERIOD - 8):
        near[s:] |= near[:-s].copy()
    near &= np.resize(np.isin(np.arange(PERIOD), COVER), len(text))
    depth = width - PERIOD + 1
    rank = _ranks(words, np.flatnonzero(near), len(text), depth)

    group = np.cumsum(first_of) - 1
    leader = np.flatnonzero(first_of)[group]
    open_ = np.flatnonzero(~first_of)
    while len(open_):
        a, b = at[open_], at[leader[open_]]
        shift = SHIFT[a % PERIOD, b % PERIOD]
        equal = rank[a + shift] == rank[b + shift]
        for s in (0, PERIOD - 9, width - PERIOD + 1, width - 8):
            equal &= words[a + s] == words[b + s]
        open_ = open_[~equal]
        if len(open_):  # these shared a fingerprint only: the first of each group leads the rest
            lead = np.r_[True, leader[open_][1:] != leader[open_][:-1]]
            leader[open_] = open_[np.maximum.accumulate(np.where(lead, np.arange(len(open_)), 0))]
            open_ = open_[~lead]
    order = np.argsort(leader, kind="stable")
    new = np.flatnonzero(np.r_[True, leader[order][1:] != leader[order][:-1]])
    mine = ids[stretch[own[order]]]
    least = np.repeat(np.minimum.reduceat(mine, new), np.diff(np.r_[new, len(order)]))
    marked[own[order]] = mine > least
    return marked


def _settled(width: int):
    """A bucket's rows to replies (block, payload): first windows in the block, and how many, that are to go."""

    def run(key: tuple, batches: pa.Table) -> pa.Table:
        replies, starts, counts, ids, texts, of_row, blocks = [], [], [], [], [], [], []
        for block, found, payload in zip(batches["block"].to_pylist(), batches["found"].to_pylist(), batches["payload"].to_pylist(), strict=True):
            if found:
                replies.append((block, payload))
                continue
            start, count, own, text = _unpacked(payload, 3)
            for held, x in ((starts, start), (counts, count), (ids, own), (texts, text), (of_row, np.full(len(start), len(blocks)))):
                held.append(x)
            blocks.append(block)
        if blocks:
            start, count, of_row = np.concatenate(starts), np.concatenate(counts), np.concatenate(of_row)
            size = count + width - 1
            gone = repeated_windows(np.concatenate(texts), np.cumsum(size) - size, count, np.concatenate(ids), width)
            stretch = np.repeat(np.arange(len(count)), count)
            edge = np.r_[True, stretch[1:] != stretch[:-1]]
            begin = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
            end = np.flatnonzero(gone & (np.r_[edge[1:], True] | ~np.r_[gone[1:], False])) + 1
            of = stretch[begin]
            where = start[of] + (begin - (np.cumsum(count) - count)[of])
            edges = np.searchsorted(of_row[of], np.arange(len(blocks) + 1))
            for i, block in enumerate(blocks):
                s = slice(edges[i], edges[i + 1])
                if edges[i] < edges[i + 1]:
                    replies.append((block, _packed(where[s], (end - begin)[s])))
        return pa.table({"block": pa.array([b for b, _ in replies], pa.string()), "payload": pa.array([p for _, p in replies], pa.binary())})

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,length:long>>, kept binary"


def _applied(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw, at, _, _ = _read(row)
                change = np.zeros(len(raw) + 1, np.int32)
                for payload in row["replies"] or ():
                    start, count, _ = _unpacked(payload, 2)
                    np.add.at(change, start, 1)
                    np.subtract.at(change, start + count + width - 1, 1)
                gone = np.cumsum(change[:-1]) > 0
                edge = np.zeros(len(raw) + 1, bool)
                edge[at] = True
                begin = np.flatnonzero(gone & (edge[:-1] | ~np.r_[False, gone[:-1]]))
                end = np.flatnonzero(gone & (edge[1:] | ~np.r_[gone[1:], False])) + 1
                upto = np.searchsorted(begin, at)
                doc = np.searchsorted(at, begin, side="right") - 1
                removed = np.r_[0, np.cumsum(end - begin)][upto]
                spans = pa.StructArray.from_arrays([pa.array(begin - at[doc]), pa.array(end - begin)], ["start", "length"])
                kept_at = at - removed
                kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(kept_at.astype(np.int64).tobytes()), pa.py_buffer(raw[~gone].tobytes())])
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), spans)
                columns = [pa.array(row["ids"], pa.int64()), pa.array(np.diff(at)), pa.array(np.diff(removed)), pa.array(np.diff(upto)), lists, kept.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept: the UTF-8 bytes of each text but those that go.

    A byte goes if a string of ``width`` bytes that covers it also starts in a document of a smaller id. ``spans``: the
    maximal runs that go; ``kept``: the others, which may end within a character.
    """
    if width < 2 * GRAM:
        raise ValueError(f"a width of {2 * GRAM} bytes or more is wanted")
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = cut(rows.mapInArrow(_blocks, BLOCK_ROW), "blocks")
    total = blocks.agg(F.sum("n_bytes")).head()[0] or 0
    # A stretch has about half as many windows as a window has grams, and width - 1 bytes more.
    buckets = max(1, round(total * (1 + 2 * width / (width - GRAM)) / BUCKET_BYTES))
    spread = max(1, buckets // 4)
    sent = blocks.mapInArrow(_sent(buckets, width), "bucket long, block string, payload binary").repartition(spread, "bucket")
    seen = cut(sent.groupBy("bucket").applyInArrow(_seen, "block string, bucket long, bits binary"), "seen")
    lists = seen.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("seen"))
    dealt = blocks.join(lists, "block", "left").select("block", "ids", "ends", "data", "seen")
    dealt = dealt.mapInArrow(_dealt(buckets, width), "bucket long, block string, found boolean, payload binary").repartition(spread, "bucket")
    replies = cut(dealt.groupBy("bucket").applyInArrow(_settled(width), "block string, payload binary"), "replies")
    remove(spark, seen)
    lists = replies.groupBy("block").agg(F.collect_list("payload").alias("replies"))
    joined = blocks.join(lists, "block", "left").select("block", "ids", "ends", "data", "replies")
    return joined.mapInArrow(_applied(width), RESULT)
