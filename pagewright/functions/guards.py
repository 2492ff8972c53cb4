"""Checks on the driver of what users hand in: regular expressions, paths, profiles, rule files. No data passes here."""

from __future__ import annotations

import hashlib
import json
import re
from re import _parser
from urllib.parse import unquote

from pagewright.functions import fixed as V

#: A pattern is refused beyond this length.
PATTERN_LENGTH = 10_000
#: A rule file is refused beyond this size.
RULES_BYTES = 10 << 20

#: Repeats of more than so many times count as unbounded ones.
MANY_TIMES = 20


def _children(op: object, arg: object) -> list[list]:
    """The sequences that an item of a parsed expression holds."""
    name = str(op)
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        return [list(arg[2])]
    if name == "SUBPATTERN":
        return [list(arg[3])]
    if name == "BRANCH":
        return [list(x) for x in arg[1]]
    if name in ("ASSERT", "ASSERT_NOT"):
        return [list(arg[1])]
    return [list(arg)] if name == "ATOMIC_GROUP" else [list(x) for x in arg[1:] if x] if name == "GROUPREF_EXISTS" else []


def _least(sequence: list) -> int:
    """Characters that a parsed sequence takes at least."""
    total = 0
    for op, arg in sequence:
        parts = [_least(x) for x in _children(op, arg)]
        if str(op).endswith("_REPEAT"):
            total += arg[0] * parts[0]
        elif not str(op).startswith("ASSERT"):
            total += min(parts) if parts else int(str(op) != "AT")
    return total


def _first(sequence: list) -> set[str] | None:
    """What a parsed sequence can begin with, as texts of its items; None if that is anything."""
    out: set[str] = set()
    for op, arg in sequence:
        if str(op) == "AT" or str(op).startswith("ASSERT"):
            continue
        if str(op) in ("ANY", "GROUPREF", "GROUPREF_EXISTS", "NOT_LITERAL"):
            return None
        inner = _children(op, arg)
        if inner:
            for part in inner:
                found = _first(part)
                if found is None:
                    return None
                out |= found
        else:
            items = arg if str(op) == "IN" else [(op, arg)]
            if any(str(o) in ("NEGATE", "CATEGORY", "RANGE") for o, _ in items):
                return None
            out |= {f"{o}:{x}" for o, x in items}
        if _least([(op, arg)]) > 0:
            break
    return out


def _wide(op: object, arg: object) -> bool:
    return str(op) in ("MAX_REPEAT", "MIN_REPEAT") and (arg[1] > MANY_TIMES)


def may_backtrack(pattern: str) -> bool:
    """Whether a regular expression can take time exponential, or of a high power, in the text.

    Its parsed form is walked: a repeat without bound that holds another one, or something that may be empty, or
    alternatives that can begin alike; and two such repeats of anything, one after the other.
    """
    waiting = [(list(_parser.parse(pattern)), False)]
    while waiting:
        sequence, repeated = waiting.pop()
        for (op, arg), (after, more) in zip(sequence, [*sequence[1:], (None, None)], strict=False):
            if _wide(op, arg) and after is not None and _wide(after, more) and _first(list(arg[2])) is None and _first(list(more[2])) is None and str(list(arg[2])) == str(list(more[2])):
                return True
            if repeated and str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] > 1:
                return True
            if repeated and str(op) == "BRANCH":
                firsts = [_first(x) for x in _children(op, arg)]
                if any(x is None for x in firsts) or any(_least(x) == 0 for x in _children(op, arg)) or sum(map(len, firsts)) > len(set().union(*firsts)):
                    return True
            again = (_wide(op, arg) or str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 1) and str(op) != "POSSESSIVE_REPEAT"
            if again and _least(list(arg[2])) == 0:
                return True
            waiting += [(x, repeated or again) for x in _children(op, arg)]
    return False


def custom_patterns(specs: list[str | tuple[str, float]]) -> list[tuple[str, float, str]]:
    """(pattern, weight, name) of patterns, or pairs of pattern and weight, that a user adds; raises on unsafe ones."""
    out = []
    for i, spec in enumerate(specs):
        pattern, weight = spec if isinstance(spec, tuple) else (spec, 0.5)
        name = f"custom_pattern_{i + 1}"
        if not pattern.strip():
            continue
        if len(pattern) > PATTERN_LENGTH:
            raise ValueError(f"{name} is longer than {PATTERN_LENGTH} characters")
        if not 0.0 <= weight <= 1.0:
            raise ValueError(f"the weight {weight} of {name} is not from 0 to 1")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"{name} is no regular expression: {e}") from e
        if may_backtrack(pattern):
            raise ValueError(f"{name} may backtrack without bound")
        out.append((pattern, weight, name))
    return out


def with_weights(patterns: list[tuple[str, float, str]], weights: dict[str, float]) -> list[tuple[str, float, str]]:
    """The patterns with the weights that a user sets by pattern; those that aren't there are added as custom ones."""
    known = {p for p, _, _ in patterns}
    own = [(p, weights.get(p, w), name) for p, w, name in patterns]
    return own + custom_patterns([(p, w) for p, w in weights.items() if p not in known])


def fingerprint(patterns: list[tuple[str, float, str]]) -> str:
    """A hash of a pattern set, the same for the same patterns and weights in the same order."""
    return hashlib.sha256(json.dumps([{"pattern": p, "weight": w} for p, w, _ in patterns], sort_keys=True).encode()).hexdigest()


def safe_path(path: str, roots: tuple[str, ...] = ()) -> str:
    """The path, if it has no NUL, no way up, plain or encoded, and lies under one of ``roots`` (any, if none is given)."""
    plain = path
    for _ in range(5):
        plain = unquote(plain)
    parts = re.split(r"[/\\]", plain)
    if "\0" in plain or ".." in parts:
        raise ValueError(f"unsafe path {path!r}")
    if roots and not any(plain == r.rstrip("/") or plain.startswith(r.rstrip("/") + "/") for r in roots):
        raise ValueError(f"{path!r} lies outside {', '.join(roots)}")
    return path


def unknown_keys(given: dict, known: set[str]) -> list[str]:
    """Keys of a configuration that mean nothing, in order."""
    return sorted(set(given) - known)


def with_profile(given: dict) -> dict:
    """A configuration with its output profile's values under those that are given."""
    name = given.get("output_profile", "default")
    if name not in V.OUTPUT_PROFILES:
        raise ValueError(f"unknown output profile {name!r}")
    return {**V.OUTPUT_PROFILES[name], **given}


def config_of(*layers: dict | None) -> dict:
    """One configuration of several, the first of which count most: given values, files, environment, defaults."""
    out: dict = {}
    for layer in layers:
        out = {**(layer or {}), **out}
    return with_profile(out)


def keyword_rules(text: str) -> list[tuple[str, str, str, list[list[str]]]]:
    """(name, severity, category, alternatives) of a rule file's ``rule NAME { ... }`` blocks, braces matched by depth.

    A block has lines ``severity = "..."``, ``category = "..."``, keywords ``$a = "..."`` and a condition: an ``or`` of
    ``and``s of keywords; without one, any keyword counts.
    """
    if len(text.encode()) > RULES_BYTES:
        raise ValueError(f"a rule file has more than {RULES_BYTES} bytes")
    out = []
    for head in re.finditer(r"\brule\s+(\w+)\s*\{", text):
        depth, end = 1, head.end()
        while depth and end < len(text):
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        if depth:
            raise ValueError(f"rule {head[1]} is not closed")
        body = text[head.end() : end - 1]
        meta = dict(re.findall(r'\b(severity|category)\s*=\s*"([^"]*)"', body))
        words = dict(re.findall(r'(\$\w+)\s*=\s*"([^"]*)"', body))
        condition = re.search(r"condition:\s*(.+)", body, re.S)
        either = re.split(r"\bor\b", condition[1]) if condition else list(words)
        every = [[words[k].lower() for k in re.findall(r"\$\w+", part) if k in words] for part in either]
        out.append((head[1], meta.get("severity", "medium"), meta.get("category", "unknown"), [x for x in every if x]))
    return out
