"""Normalised Markdown: fences and indented code stay, other lines collapse."""

import pyarrow as pa
import pytest

from pagewright.functions import text as T
from pagewright.functions.slices import SLICE_ROWS
from pagewright.functions.text import normal_lines, normalised


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("  a   b \n\n\n\n c\t d  ", "a b\n\nc d"),
        ("```py\n  x  =  1\n\n\n```\n\n\nz", "```py\n  x  =  1\n\n\n```\n\nz"),
        ("````\n```\nx  y\n````\nb   c", "````\n```\nx  y\n````\nb c"),
        ("~~~\nopen  end", "~~~\nopen  end\n~~~"),
        ("p\n\n    code   kept\n    more   kept\nout   side", "p\n\n    code   kept\n    more   kept\nout side"),
        ("p\n    not   code", "p\nnot code"),
        ("- a   b\n  - c    d\n   tail   x\n> q   r", "- a b\n  - c d\n   tail x\n> q r"),
        ("1. a   b\n\nc", "1. a b\n\nc"),
        ("", ""),
        ("\n \n", ""),
    ],
)
def test_lines(text, wanted):
    assert normal_lines(text) == wanted
    assert normal_lines(wanted) == wanted


def test_column(spark):
    rows = spark.createDataFrame([(1, "e\u0301  \u200bx"), (2, None)], "id int, t string").orderBy("id")
    assert [r.n for r in rows.select(normalised("t").alias("n")).collect()] == ["\u00e9 x", None]


def test_texts_go_on_in_slices():
    """A batch of any size comes out in slices; nulls and order stay."""
    for of, wanted in [(T._folded, "e"), (T._spaced_and_folded, "e"), (T.normalised, "\u00e9"), (T.decode_fully, {"text": "\u00e9", "too_deep": False})]:
        parts = list(of.func(iter([pa.array(["\u00e9"] * 999 + [None])])))
        rows = [x for p in parts for x in p.to_pylist()]
        assert max(map(len, parts)) == SLICE_ROWS and rows[:999] == [wanted] * 999
        assert rows[999:] == [{"text": None, "too_deep": False} if of is T.decode_fully else None]
