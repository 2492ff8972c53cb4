"""What a style attribute says: declarations with comments, strings, functions, units and arithmetic; whether it hides."""

from __future__ import annotations

import re
from collections.abc import Iterator

# What hides an element. Lengths that hide at nothing, offsets that leave the screen, and from where on.
NOTHING = frozenset("opacity width height font-size max-width max-height".split())
KEYWORDS = {"display": {"none"}, "visibility": {"hidden", "collapse"}, "content-visibility": {"hidden"}, "color": {"transparent"}}
OFFSETS = frozenset("left top right bottom text-indent margin-left margin-top".split())
OFF_SCREEN = -999.0

_TOKEN = re.compile(r"""\s+|/\*.*?(?:\*/|$)|"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$)|\\[0-9a-fA-F]{1,6}\s?|\\.|[^\s"'/\;:(),]+|.""", re.S)
_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)([a-z%]*)")
_PIXELS = {"em": 16.0, "rem": 16.0, "ex": 8.0, "ch": 8.0, "pt": 4 / 3, "pc": 16.0, "in": 96.0, "cm": 96 / 2.54, "mm": 9.6 / 2.54}


def _plain(token: str) -> str:
    """A token with its escapes undone."""
    if token.startswith("\\"):
        digits = token[1:].strip()
        if re.fullmatch(r"[0-9a-fA-F]{1,6}", digits):
            code = int(digits, 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        return token[1:]
    return token


def declarations(style: str) -> Iterator[tuple[str, str, bool]]:
    """(property, value, important) of each declaration, in lower case, blanks single; a ';' inside (), '' or "" is text."""
    name, value, depth, in_value = "", "", 0, False
    for token in [*_TOKEN.findall(style), ";"]:
        if token.startswith("/*"):
            continue
        if token == ";" and depth <= 0:
            held = " ".join(value.lower().split())
            important = bool(re.search(r"!\s*important$", held))
            if in_value and name.strip():
                yield name.strip().lower(), re.sub(r"\s*!\s*important$", "", held), important
            name, value, depth, in_value = "", "", 0, False
            continue
        depth += {"(": 1, ")": -1}.get(token, 0)
        if token == ":" and not in_value:
            in_value = True
        elif in_value:
            value += " " if token.isspace() else _plain(token)
        else:
            name += _plain(token)
    if depth > 0 and in_value and name.strip():  # a function that isn't closed ends with the style
        yield name.strip().lower(), " ".join(value.lower().rstrip(";").split()) + ")" * depth, False


def number(value: str) -> tuple[float, str] | None:
    """(number, unit) of a value that is one number, or a sum of such of one unit in calc(); else None."""
    value = value.strip()
    inner = re.fullmatch(r"calc\((.*)\)", value)
    if not inner:
        found = _NUMBER.fullmatch(value)
        return (float(found[1]), found[2]) if found else None
    terms = re.split(r"\s([+-])\s", inner[1].replace("(", " ").replace(")", " "))
    total, units = 0.0, set()
    for sign, term in zip(["+", *terms[1::2]], terms[::2], strict=True):
        product, unit = 1.0, ""
        factors = re.split(r"\s*([*/])\s*", term.strip())
        for how, factor in zip(["*", *factors[1::2]], factors[::2], strict=True):
            found = _NUMBER.fullmatch(factor)
            if not found or how == "/" and float(found[1]) == 0:
                return None
            product = product / float(found[1]) if how == "/" else product * float(found[1])
            unit = unit or found[2]
        total += product if sign == "+" else -product
        units.add(unit)
    units.discard("") if total == 0 else None
    return (total, units.pop() if units else "") if len(units) < 2 else None


def functions(value: str) -> Iterator[tuple[str, list[str]]]:
    """(name, arguments) of the functions of a value, those that stand in one another's arguments left as text."""
    at = 0
    while opened := re.compile(r"([a-z0-9-]+)\(").search(value, at):
        depth, end, start, args = 1, opened.end(), opened.end(), []
        while depth and end < len(value):
            c = value[end]
            depth += {"(": 1, ")": -1}.get(c, 0)
            if depth == 1 and c == "," or depth == 0:
                args.append(value[start:end].strip())
                start = end + 1
            end += 1
        if depth:
            args.append(value[start:].strip())
        yield opened[1], args
        at = end


def _nothing(value: str) -> bool:
    found = number(value)
    return found is not None and found[0] <= 0


def _off_screen(value: str) -> bool:
    found = number(value)
    return found is not None and found[0] * _PIXELS.get(found[1], 1.0) <= OFF_SCREEN


def _clear(value: str) -> bool:
    """A colour without any opacity."""
    if re.fullmatch(r"#[0-9a-f]{3}0|#[0-9a-f]{6}00", value):
        return True
    for name, args in functions(value):
        if name in ("rgb", "rgba", "hsl", "hsla", "hwb", "lab", "lch", "oklab", "oklch", "color"):
            alpha = args[0].rpartition("/")[2] if len(args) == 1 and "/" in args[0] else args[3] if len(args) == 4 else "1"
            return _nothing(alpha)
    return False


def _moved_away(value: str) -> bool:
    for name, args in functions(value):
        if name in ("scale", "scalex", "scaley", "scale3d") and any(_nothing(a) and number(a)[0] == 0 for a in args[:2]):
            return True
        if name in ("translate", "translatex", "translatey", "translate3d") and any(_off_screen(a) for a in args[:2]):
            return True
        if name == "matrix" and len(args) == 6 and (all(number(a) and number(a)[0] == 0 for a in args[:4]) or any(_off_screen(a) for a in args[4:])):
            return True
    return False


def _cut_away(name: str, value: str) -> bool:
    for kind, args in functions(value):
        sizes = [number(x) for x in " ".join(args).split()]
        if name == "clip" and kind == "rect" and sizes and all(x is not None for x in sizes):
            top, right, bottom, left = ([x[0] for x in sizes] * 4)[:4] if len(sizes) < 4 else [x[0] for x in sizes[:4]]
            return top >= bottom or left >= right
        if name == "clip-path" and kind == "inset" and sizes and all(x is not None and x[1] == "%" for x in sizes):
            sides = [x[0] for x in sizes]
            across = sides[1] if len(sides) > 1 else sides[0]
            return sides[0] + (sides[2] if len(sides) > 2 else sides[0]) >= 100 or across + (sides[3] if len(sides) > 3 else across) >= 100
        if name == "clip-path" and kind in ("circle", "ellipse") and args and _nothing(args[0].split(" at ")[0].split()[0] if args[0].split() else "1"):
            return True
    return False


def hides(style: str) -> bool:
    """Whether any declaration of a style hides its element; one that a later declaration overrides counts as well."""
    for name, value, _ in declarations(style):
        if (
            value in KEYWORDS.get(name, ())
            or name in NOTHING and _nothing(value)
            or name in OFFSETS and _off_screen(value)
            or name == "color" and _clear(value)
            or name in ("transform", "translate", "scale") and _moved_away(value if name == "transform" else f"{name}({value.replace(' ', ',')})")
            or name in ("clip", "clip-path") and _cut_away(name, value)
            or name == "filter" and any(f == "opacity" and a and _nothing(a[0]) for f, a in functions(value))
        ):
            return True
    return False
