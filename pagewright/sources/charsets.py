"""Bytes of pages to text: a byte order mark, then the header's charset, then the one that the page declares, then UTF-8.

The declared name is found in the first bytes, read as Latin-1. UTF-8 and charsets of one byte a character are decoded in
columns, the latter as Latin-1 with their upper half put in place; the others by a small Arrow function, which gets the
bytes of such pages only. A name that isn't known counts as none. Bytes that a charset doesn't have become U+FFFD.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes in which a page may declare its charset.
DECLARED_WITHIN = 1024
# Other names of charsets, and byte order marks.
NAMES = {
    "utf8": "UTF-8", "utf-8": "UTF-8", "unicode-1-1-utf-8": "UTF-8", "utf-16": "UTF-16LE", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "ascii": "windows-1252", "us-ascii": "windows-1252", "latin1": "windows-1252",
    "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "l1": "windows-1252", "cp1252": "windows-1252", "windows-1252": "windows-1252", "x-cp1252": "windows-1252", "iso-8859-2": "ISO-8859-2", "latin2": "ISO-8859-2",
    "iso-8859-15": "ISO-8859-15", "latin9": "ISO-8859-15", "windows-1250": "windows-1250", "cp1250": "windows-1250", "windows-1251": "windows-1251", "cp1251": "windows-1251", "koi8-r": "KOI8-R", "shift_jis": "Shift_JIS",
    "shift-jis": "Shift_JIS", "sjis": "Shift_JIS", "euc-jp": "EUC-JP", "gb2312": "GBK", "gbk": "GBK", "gb18030": "GB18030", "big5": "Big5", "euc-kr": "EUC-KR",
}
MARKS = [("EFBBBF", "UTF-8"), ("FEFF", "UTF-16BE"), ("FFFE", "UTF-16LE")]


def known(name: Column) -> Column:
    """A charset by any of its names, or null."""
    bare = F.regexp_replace(F.lower(F.trim(name)), r"^[\"']|[\"']$", "")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair)), bare)


def charset_of(content: Column, header: Column) -> Column:
    """The charset of a page's bytes; ``header``: its content type, may be null."""
    start = F.hex(F.substring(content, 1, 3))
    head = F.decode(F.substring(content, 1, DECLARED_WITHIN), "ISO-8859-1")
    by_mark = F.when(F.lit(False), "")
    for mark, name in MARKS:
        by_mark = by_mark.when(start.startswith(mark), name)
    by_header = known(F.regexp_extract(F.coalesce(header, F.lit("")), r"(?i)charset\s*=\s*([^\s;,]+)", 1))
    # A page whose declaration can be read byte by byte isn't in UTF-16, whatever it says.
    in_page = known(F.regexp_extract(head, r"(?is)<meta\s[^>]*?charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", 1))
    in_page = F.when(in_page.startswith("UTF-16"), "UTF-8").otherwise(in_page)
    return F.coalesce(by_mark, by_header, in_page, F.lit("UTF-8"))


#: Charsets of one byte a character.
SINGLE = ("windows-1252", "ISO-8859-2", "ISO-8859-15", "windows-1250", "windows-1251", "KOI8-R")
_UPPER = "".join(map(chr, range(128, 256)))


@F.pandas_udf(StringType())
def _wide(content: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode(n, "replace") for c, n in zip(content, name, strict=True)], dtype=object)


def decoded(content: Column, header: Column | None = None) -> Column:
    """Text of a page's bytes, without the byte order mark; null for null."""
    name = charset_of(content, F.lit(None).cast("string") if header is None else header)
    latin = F.decode(content, "ISO-8859-1")
    out = F.when(name == "UTF-8", F.make_valid_utf8(content.cast("string")))
    for charset in SINGLE:
        upper = bytes(range(128, 256)).decode(charset, "replace")
        changed = [(a, b) for a, b in zip(_UPPER, upper, strict=True) if a != b]
        out = out.when(name == charset, F.translate(latin, "".join(a for a, _ in changed), "".join(b for _, b in changed)))
    narrow = name.isin("UTF-8", *SINGLE)
    return F.regexp_replace(out.otherwise(_wide(F.when(~narrow, content), name)), "^\ufeff", "")
