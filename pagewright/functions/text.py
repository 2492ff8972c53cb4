"""Text columns: folding to ASCII, invisible characters, Unicode forms, encodings."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from pagewright.functions.fixed import DIRECTION_MARKS, LOOKALIKE_PAIR, LOOKALIKES, SPACES, ZERO_WIDTH
from pagewright.functions.slices import sliced

#: Rounds of decoding after which a text counts as encoded too deeply.
DECODE_ROUNDS = 10


class _Folds(dict):
    """What each character becomes, found when it is met first: compatibility form, decomposed, without what isn't ASCII.

    Composition across characters changes nothing, as it is undone and the marks are dropped.
    """

    def __missing__(self, c: str) -> str:
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
        self[c] = found = plain.encode("ascii", "ignore").decode("ascii")
        return found


_ALIKE = _Folds(zip(*LOOKALIKES, strict=True)) | dict([LOOKALIKE_PAIR])
_FOLDS = {False: _Folds(_ALIKE), True: _Folds(_ALIKE | dict.fromkeys(SPACES, " ") | dict.fromkeys(DIRECTION_MARKS, ""))}
_FOLDED = {False: re.compile(r"[^\x00-\x7F]"), True: re.compile(r"[^\x00-\x7F]|[\t\n\x0B\f\r]")}


def _fold(text: str, spaces: bool) -> str:
    folds = _FOLDS[spaces]
    return _FOLDED[spaces].sub(lambda m: folds[m[0]], text)


def _texts(batches: Iterator[pa.Array], of: Callable[[str], str]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from sliced(pa.string(), lambda t: None if t is None else of(t), batch)


@F.arrow_udf(StringType())
def _folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _texts(batches, lambda t: _fold(t, False))


@F.arrow_udf(StringType())
def _spaced_and_folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from _texts(batches, lambda t: _fold(t, True))


def without_zero_width(text: Column) -> Column:
    return F.translate(text, ZERO_WIDTH, "")


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def ascii_fold(text: Column) -> Column:
    """Letters that look Latin become so, compatibility forms and accents are folded, other non-ASCII is dropped.

    A text that is ASCII already doesn't go through Python.
    """
    return F.when(_is_ascii(text), text).otherwise(_folded(F.when(~_is_ascii(text), text)))


def for_matching(text: Column) -> Column:
    """``ascii_fold`` after marks of direction are gone and every kind of white space is a space."""
    return F.when(_is_ascii(text), F.regexp_replace(text, r"[\t\n\x0B\f\r]", " ")).otherwise(_spaced_and_folded(F.when(~_is_ascii(text), text)))


def _character(code: int) -> str:
    return "\ufffd" if 0xD800 <= code <= 0xDFFF or code > 0x10FFFF else chr(code)


_ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_CSS = re.compile(r"\\([0-9A-Fa-f]{1,6})\s?")
_UTF7 = re.compile(r"\+[A-Za-z0-9/]+-")


def _utf7(found: re.Match) -> str:
    try:
        return found[0].encode("ascii").decode("utf-7")
    except UnicodeDecodeError:
        return found[0]


def decode_once(text: str) -> str:
    """Entities, percent signs, script and style escapes, and UTF-7 runs, each once."""
    text = unquote(html.unescape(text))
    text = _ESCAPES.sub(lambda m: _character(int(next(filter(None, m.groups())), 16)), text)
    text = _CSS.sub(lambda m: _character(int(m[1], 16)), text)
    return _UTF7.sub(_utf7, text)


_DECODED = pa.struct([("text", pa.string()), ("too_deep", pa.bool_())])


def _decode(text: str | None) -> dict:
    if text is None:
        return {"text": None, "too_deep": False}
    for _ in range(DECODE_ROUNDS):
        after = decode_once(text)
        if after == text:
            return {"text": text, "too_deep": False}
        text = after
    return {"text": text, "too_deep": True}


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("too_deep", BooleanType())]))
def decode_fully(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The text decoded until nothing changes, and whether that took more rounds than allowed."""
    for batch in batches:
        yield from sliced(_DECODED, _decode, batch)


def decoded(text: Column) -> Column:
    """(text, too_deep), as ``decode_fully``; a text without a sign that any encoding needs doesn't go through Python."""
    plain = ~text.rlike(r"[&%\\+]")
    found = decode_fully(F.when(~plain, text))
    return F.struct(F.when(plain, text).otherwise(found["text"]).alias("text"), F.coalesce(found["too_deep"], F.lit(False)).alias("too_deep"))


_MATCHABLE = pa.struct([("bare", pa.string()), ("own", pa.string()), ("too_deep", pa.bool_())])


def _matchable(text: str | None) -> dict | None:
    if text is None:
        return None
    found = _decode(text)
    bare = _fold(found["text"], True)
    return {"bare": bare, "own": bare if found["text"] == text else _fold(text, True), "too_deep": found["too_deep"]}


@F.arrow_udf(StructType([StructField("bare", StringType()), StructField("own", StringType()), StructField("too_deep", BooleanType())]))
def _decoded_and_folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from sliced(_MATCHABLE, _matchable, batch)


def matchable(text: Column) -> Column:
    """(bare, own, too_deep): ``for_matching`` of the text with its encodings undone, and of the text as it is.

    All that needs Python is one call, so that a task has one worker for it; a plain text has none.
    """
    plain = _is_ascii(text) & ~text.rlike(r"[&%\\+]")
    spaced = F.regexp_replace(text, r"[\t\n\x0B\f\r]", " ")
    native = F.struct(spaced.alias("bare"), spaced.alias("own"), F.lit(False).alias("too_deep"))
    return F.when(plain, native).otherwise(_decoded_and_folded(F.when(~plain, text)))


_FENCE = re.compile(r"\s*(`{3,}|~{3,})(.*)$", re.S)
_MARKED = re.compile(r" *(?:[-*+][ \t]|\d+\.[ \t]|>)")
_DEEP = re.compile(r" {4}|\t")


def normal_lines(text: str) -> str:
    """Markdown with single spaces and single blank lines, none at the edges.

    Fenced code stays as it is, and an open fence is closed. Lines of four blanks or a tab after a blank line are code
    and stay too. Lists, quotes and what continues a list keep their indentation.
    """
    out: list[str] = []
    fence, in_list, in_code = "", False, False
    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if fence:
            closes = mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip()
            out.append(line.rstrip() if closes else line)
            fence = "" if closes else fence
        elif mark:
            fence, in_code = mark[1], False
            out.append(line.rstrip())
        elif not line.strip():
            if in_code or (out and out[-1]):
                out.append("")
        elif _DEEP.match(line) and (in_code or not out or not out[-1]):
            in_code = True
            out.append(line)
        else:
            in_code = False
            marked = bool(_MARKED.match(line))
            in_list = marked or (in_list and line[0] in " \t")
            indent = line[: len(line) - len(line.lstrip(" \t"))] if in_list else ""
            out.append(indent + re.sub(r"[ \t]+", " ", line.strip()))
    if fence:
        out.append(fence)
    return "\n".join(out).strip("\n")


@F.arrow_udf(StringType())
def normalised(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """NFC, no invisible characters, and ``normal_lines``; null stays null."""
    gone = dict.fromkeys(map(ord, ZERO_WIDTH))
    yield from _texts(batches, lambda t: normal_lines(unicodedata.normalize("NFC", t).translate(gone)))


def tokens_about(text: Column) -> Column:
    """Roughly how many tokens a text has: words and single other signs. Not a model's own count."""
    return F.when(text.isNotNull(), F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(text, "UTF-8"), 256))
