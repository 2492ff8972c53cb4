"""Packing and byte-level BPE against the tokenizer libraries and plain loops."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from pagewright.llm import byte_bpe as B
from pagewright.llm import packing as P

DOCS = "doc_id long, text string, length int, offset string"
ODD = [
    None, "", " ", "\n\n\t ", "Hello, World!", "naïve Straße ÜBER İstanbul ǅ", "1234567 3.14", "x" * 3000, "ab" * 700, "<|endoftext|> a <|x|>", "A<|endoftext|>B <|ENDOFTEXT|> <|startoftext|><|", "<|endoftext|>", "日本語のテキスト 한국어 العربية", "👩‍👩‍👧 é",
    "don't WON'T it's", "a b c​d", "foo_bar __init__ != <= ...", "word " * 4000, "� \x00 \x1f z", "ſ K Å",
]


def texts():
    rng = random.Random(4)
    pool = "the tion Über naïve 日本 don't 12 __ . , \n  \t ß é the, (x) ﬁ".split(" ")
    return ODD + [" ".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(150)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], DOCS)


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    for text, ids in zip(texts(), P.token_ids(pa.array(texts())), strict=True):
        assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def test_ids_of_words_cut_into_pieces(monkeypatch):
    """Contractions, digits, signs, control characters and special tokens inside words, in two blocks and a new table."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(P, "BLOCK_BYTES", 40)
    plain = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    odd = ["it's 'STRE we'll<| a<|endoftext|>b", "x'tt''s 123abc--\x01\x7f q\x00z", "İ ſ K ς Σ ¼ é it's", "'s's'LLL \x1c a\x85b", "--", "x'tt''s 123abc-- it's", "", None]
    for kept in (P.KEPT_WORDS, 1):
        monkeypatch.setattr(P, "KEPT_WORDS", kept)
        for text, ids in zip(odd, P.token_ids(pa.array(odd)), strict=True):
            assert ids.tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def test_pack(spark):
    rows = list(enumerate(texts())) + [(3, "again"), (None, "no id")]
    got = P.pack(docs(spark, rows).repartition(3), tokens=64).collect()
    ids = dict(zip(range(len(rows)), P.token_ids(pa.array([t for _, t in rows])), strict=True))
    wanted = [(rows[r][0], p, lo, len(x[lo : lo + 64]), zlib.crc32(x[lo : lo + 64].astype("<u4"))) for r, x in ids.items() for p, lo in enumerate(range(0, len(x), 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(wanted, key=str)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 64


def plain_best_fit(lengths, tokens):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(tokens - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_the_plan_over_counts_is_best_fit(seed):
    rng = random.Random(seed)
    tokens = rng.choice([10, 50, 128])
    lengths = [min(tokens, 1 + int(rng.expovariate(4 / tokens))) for _ in range(400)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots, used = P.plan(counts, tokens), defaultdict(list)
    for length, lo, hi, first, offset in slots:
        for i in range(hi - lo):
            used[first + i].append((offset, length))
    assert sorted(n for own in used.values() for _, n in own) == sorted(lengths)
    assert len(used) == plain_best_fit(lengths, tokens)
    for length in counts:
        ranks = sorted((lo, hi) for n, lo, hi, _, _ in slots if n == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == counts[length] and all(a[1] == b[0] for a, b in zip(ranks, ranks[1:]))


def test_pack_edges(spark):
    assert P.pack(docs(spark, [])).collect() == []
    got = P.pack(docs(spark, [(1, None), (2, "")])).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == [(1, 0, 0, 1), (2, 0, 0, 1)] and len({r.sequence_id for r in got}) == 1


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(public_tokenizers.path(B.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(x):
    return hashlib.sha256(x).hexdigest()


def test_bpe_equals_the_library(spark, library):
    rows = list(enumerate(texts())) + [(3, "again"), (None, "no id")]
    got = B.encode_digests(docs(spark, rows).repartition(3)).collect()
    wanted = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        wanted.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())))
    assert sorted((tuple(r) for r in got), key=str) == sorted(wanted, key=str)
    assert B.encode_digests(docs(spark, [])).collect() == []


def test_bpe_slices_of_long_texts(library, monkeypatch):
    monkeypatch.setattr(B, "SLICE", 16)
    monkeypatch.setattr(B, "KEPT_PIECES", 5)
    column = pa.array(texts())
    for text, n, ids, back in zip(texts(), *B.digests(column), strict=True):
        wanted = library.encode_ordinary(text or "")
        assert (n, ids, back) == (len(wanted), digest(",".join(map(str, wanted)).encode()), digest((text or "").encode()))


def test_bpe_matrices_and_heap_agree(library):
    rng = random.Random(6)
    held = B.vocabulary(B.VOCABULARY)
    pieces = [bytes(rng.choices(b"abetinosr\xc3\xa9\xff ", k=rng.randint(1, 300))) for _ in range(300)]
    for piece, ids in zip(pieces, held.encode(pieces), strict=True):
        assert ids.tolist() == library._core_bpe.encode_single_piece(piece)
        if piece not in held.ranks:
            assert np.array_equal(ids, held._merge_long(piece))


def test_encode_decode_columns(spark):
    rows = list(enumerate(texts()))
    back = B.decode(B.encode(docs(spark, rows))).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)


def test_pack_deals_rows_without_ids(spark, monkeypatch):
    """Equal rows in several groups of ranks: every slot is taken once, and sequences have no gaps."""
    monkeypatch.setattr(P, "GROUP_ROWS", 7)
    got = P.pack(docs(spark, [(None, "same words")] * 60 + [(5, "other same words")] * 30).repartition(4), tokens=16).collect()
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 90 and sum(r.doc_id is None for r in got) == 60
    for own in used.values():
        upto = 0
        for offset, length in sorted(own):
            assert offset == upto
            upto += length
        assert upto <= 16
    assert len(used) == plain_best_fit([r.length for r in got], 16)
