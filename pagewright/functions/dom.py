"""A small element tree for one page, and what is read off it inside one pandas UDF: see ``operators.pages``."""

from __future__ import annotations

import hashlib
import html as entities
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import unquote

from pagewright.functions.fixed import TRACKING_PARAMETERS
from pagewright.functions.styles import hides

# Elements without content, elements an opening tag ends, elements that are not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS = frozenset("address article aside blockquote body dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
UNWANTED = "script style nav footer aside iframe noscript object embed applet base".split()
ACTIVE = frozenset("script style iframe object embed form input button select textarea link meta base".split())
# Classes that hide an element.
HIDING_CLASSES = frozenset("hidden invisible hide sr-only visually-hidden".split())
_URL_ATTRIBUTES = frozenset("href src action formaction xlink:href poster data code codebase".split())
_SAFE_DATA = frozenset("image/png image/jpeg image/gif image/webp".split())
#: Words of a class or id that speak for the article, and against it.
CONTENT_WORDS = frozenset("article body content entry main page post story text".split())
ASIDE_WORDS = frozenset("ad ads advert banner breadcrumb comment comments cookie footer menu nav newsletter pagination promo related share sidebar social sponsor widget".split())
#: Elements that count as paragraphs, from so many characters on; what an article has at least.
SCORED, LEAST_SCORED, LEAST_CONTENT = frozenset("p pre td blockquote li dd".split()), 25, 50
#: Commas that count in one paragraph.
MOST_COMMAS = 10
#: Elements that are part of an article, never its whole.
WITHIN = frozenset("p pre blockquote ul ol li dl dt dd table tbody thead tfoot tr h1 h2 h3 h4 h5 h6 a span b i em strong".split())
#: Indentation and quote marks before a line end their growth at so many characters, however deep the blocks lie.
MOST_INDENT = 200
BLOCK_TYPES = {**{f"h{i}": "heading" for i in range(1, 7)}, "p": "paragraph", "ul": "list", "ol": "list", "blockquote": "quote", "pre": "code", "table": "table"}

_IN_BLOCKS = frozenset(BLOCK_TYPES) - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def nodes(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        waiting = [c for c in reversed(self.children) if isinstance(c, Node)]
        while waiting:
            node = waiting.pop()
            yield node
            waiting += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, between: str = " ") -> str:
        out, waiting = [], list(reversed(self.children))
        while waiting:
            item = waiting.pop()
            if isinstance(item, str):
                out.append(item)
            elif item.tag not in ("script", "style"):
                waiting += reversed(item.children)
        return " ".join(between.join(out).split())

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.nodes() if n.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = ENDED_BY.get(tag, {"p"} if tag in BLOCKS else set())
        node = self.at  # what is ended may hold unclosed inline elements
        while ends and node.parent is not None and (node.tag in ends or node.tag not in BLOCKS):
            if node.tag in ends:
                self.at = node.parent
            node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x80-\x9f]", "", html))
    builder.close()
    return builder.root


def discard(nodes: list[Node]) -> None:
    """Take nodes out of their tree; each parent's children are gone through once."""
    gone = set(map(id, nodes))
    for parent in {id(n.parent): n.parent for n in nodes if n.parent is not None}.values():
        parent.children = [c for c in parent.children if id(c) not in gone]


def unwrap(nodes: list[Node]) -> None:
    """Put what nodes hold in their place; each parent that stays gets its children once."""
    gone = set(map(id, nodes))
    for parent in {id(n.parent): n.parent for n in nodes if n.parent is not None and id(n.parent) not in gone}.values():
        out: list[Node | str] = []
        waiting = list(reversed(parent.children))
        while waiting:
            item = waiting.pop()
            if isinstance(item, Node) and id(item) in gone:
                waiting += reversed(item.children)
                continue
            if isinstance(item, Node):
                item.parent = parent
            out.append(item)
        parent.children = out


def is_hidden(node: Node) -> bool:
    a = node.attrs
    return "hidden" in a or a.get("aria-hidden") == "true" or not HIDING_CLASSES.isdisjoint(a.get("class", "").split()) or bool(a.get("style") and hides(a["style"]))


def remove_hidden(root: Node) -> int:
    found = [n for n in root.nodes() if is_hidden(n)]
    discard(found)
    return len(found)


def remove_tags(root: Node, tags: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    found = [n for n in root.nodes() if n.tag in tags]
    discard(found)
    for node in found:
        counts[node.tag] = counts.get(node.tag, 0) + 1
    return counts


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[tuple[str, tuple[tuple[str, str, str], ...]], ...]:
    """(tag or '', conditions) of each compound of a selector, the innermost first; a condition is (kind, name, value)."""
    out = []
    for compound in reversed(selector.split()):
        simple = re.fullmatch(r"([\w-]*|\*)((?:[.#][\w-]+|\[[^\]]+\])*)", compound)
        if not simple:
            raise ValueError(f"unsupported selector {selector!r}")
        conditions = []
        for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", simple[2]):
            if part[0] != "[":
                conditions.append((part[0], "", part[1:]))
                continue
            found = re.fullmatch(r"\[([\w:-]+)\s*(\*?=)?\s*[\"']?([^\"'\]]*)[\"']?\]", part)
            if not found:
                raise ValueError(f"unsupported selector {selector!r}")
            conditions.append((found[2] or "has", found[1], found[3]))
        out.append((simple[1].replace("*", ""), tuple(conditions)))
    return tuple(out)


def _fits(node: Node, compound: tuple[str, tuple[tuple[str, str, str], ...]]) -> bool:
    tag, conditions = compound
    if tag and tag != node.tag:
        return False
    for kind, name, value in conditions:
        held = node.attrs.get(name) if name else None
        if kind == ".":
            fine = value in node.attrs.get("class", "").split()
        elif kind == "#":
            fine = node.attrs.get("id") == value
        else:
            fine = held is not None and (kind == "has" or kind == "=" and held == value or kind == "*=" and value in held)
        if not fine:
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    """A compound of tag, .class, #id, [a], [a=v] and [a*=v]; spaces stand for descendants."""
    own, *outer = compiled(selector)
    if not _fits(node, own):
        return False
    up = node.parent
    for compound in outer:  # the nearest ancestor that fits leaves most ancestors to the next
        while up is not None and up.tag and not _fits(up, compound):
            up = up.parent
        if up is None or not up.tag:
            return False
        up = up.parent
    return True


def apply_rules(root: Node, blocked_selectors=(), unwrap_selectors=(), blocked_tags=(), allowed_tags=()) -> int:
    """Blocked parts go, unwrapped ones leave their content, and so do tags that aren't allowed; how many changed."""
    def picked(selectors):
        return [n for n in root.nodes() if any(matches(n, s) for s in selectors)]

    changed = picked(blocked_selectors)
    discard(changed)
    unwrapped = picked(unwrap_selectors)
    unwrap(unwrapped)
    n = len(changed) + len(unwrapped) + sum(remove_tags(root, [t.lower() for t in blocked_tags]).values())
    if allowed_tags:
        n += sum(remove_tags(root, [t for t in ACTIVE if t not in allowed_tags]).values())
        others = [x for x in root.nodes() if x.tag not in allowed_tags and x.tag not in ("html", "body")]
        unwrap(others)
        n += len(others)
    return n


def is_dangerous(url: str) -> str | None:
    """javascript, vbscript or data (other than plain pictures) if a URL has that scheme under any disguise."""
    text = url.strip()
    for _ in range(5):
        after = entities.unescape(unquote(text))
        if after == text:
            break
        text = after
    text = unicodedata.normalize("NFKC", text).lower()
    bare = "".join(c for c in text if not c.isspace() and unicodedata.category(c) not in ("Cc", "Cf", "Mn"))
    scheme, colon, rest = bare.partition(":")
    if not colon or scheme not in ("javascript", "vbscript", "data"):
        return None
    media, comma, _ = rest.partition(",")
    return None if scheme == "data" and comma and media.split(";")[0] in _SAFE_DATA else scheme


#: What ``sanitize`` counts.
SANITIZED = ("event_handlers", "style_attributes", "javascript_urls", "vbscript_urls", "data_urls")


def sanitize(root: Node) -> dict[str, int]:
    counts = dict.fromkeys(SANITIZED, 0)
    for node in root.nodes():
        for name, value in list(node.attrs.items()):
            if not value:
                continue
            if name in ("srcset", "imagesrcset"):
                del node.attrs[name]
                counts["data_urls"] += any(is_dangerous(x) == "data" or x.strip().lower().startswith("data:") for x in value.split(","))
                continue
            scheme = is_dangerous(value) if name in _URL_ATTRIBUTES else None
            kind = "event_handlers" if name.startswith("on") else "style_attributes" if name == "style" else scheme and f"{scheme}_urls"
            if kind:
                del node.attrs[name]
                counts[kind] += 1
    return counts


def without_tracking(url: str) -> str:
    """The URL without query parameters that only track."""
    bare, mark, fragment = url.partition("#")
    where, question, query = bare.partition("?")
    kept = [x for x in query.split("&") if x.partition("=")[0].lower() not in TRACKING_PARAMETERS]
    return where + ("?" + "&".join(kept) if question and kept else "") + mark + fragment


class _Texts:
    """Of each element, the characters of its text and of that in links, without recursion."""

    def __init__(self, root: Node) -> None:
        self.all: dict[int, int] = {}
        self.linked: dict[int, int] = {}
        waiting: list[tuple[Node, bool]] = [(root, False)]
        while waiting:
            node, done = waiting.pop()
            inner = [] if node.tag in ("script", "style") else [c for c in node.children if isinstance(c, Node)]
            if not done:
                waiting.append((node, True))
                waiting += [(c, False) for c in inner]
                continue
            own = 0 if node.tag in ("script", "style") else sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
            self.all[id(node)] = own + sum(self.all[id(c)] for c in inner)
            self.linked[id(node)] = self.all[id(node)] if node.tag == "a" else sum(self.linked[id(c)] for c in inner)

    def density(self, node: Node) -> float:
        return self.linked[id(node)] / max(1, self.all[id(node)])


def _prior(node: Node) -> float:
    """What an element is worth by its tag and by the words of its class and id."""
    words = set(re.split(r"[^a-z]+", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()))
    named = 25.0 * (not words.isdisjoint(CONTENT_WORDS)) - 25.0 * (not words.isdisjoint(ASIDE_WORDS))
    return named + {"article": 10.0, "main": 10.0, "div": 5.0, "section": 5.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "form": -3.0, "aside": -25.0, "nav": -25.0, "footer": -25.0, "header": -5.0}.get(node.tag, 0.0)


def main_content(root: Node) -> Node:
    """The element that holds the article, together with what belongs to it of its siblings; the body if that is short.

    A paragraph's commas and length make its score, which its parent gets whole, and the elements above it by halves; an
    element's sum counts by the share of its text that is no link. Siblings of the best one belong to it if they score a
    fifth of it, or are paragraphs of plain text, headings, or lists, tables and code with few links.
    """
    body = root.find("body") or root
    texts = _Texts(body)
    scores: dict[int, float] = {}
    known: dict[int, Node] = {}
    for node in body.nodes():
        size = texts.all.get(id(node), 0)
        if node.tag not in SCORED or size < LEAST_SCORED:
            continue
        commas = sum(c.count(",") for c in node.children if isinstance(c, str))
        value = 1.0 + min(size // 100, 3) + min(commas, size // 25, MOST_COMMAS)
        up, share = node.parent, 1.0
        while up is not None and up.tag and share >= 0.25:
            if up.tag in WITHIN and up is not body:
                up = up.parent
                continue
            if id(up) not in scores:
                known[id(up)] = up
                scores[id(up)] = _prior(up)
            scores[id(up)] += value * share
            if up is body:
                break
            up, share = up.parent, share / 2
    final = {k: v * (1 - texts.density(known[k])) if v > 0 else v for k, v in scores.items()}
    best = max((k for k in final if known[k] is not body), key=lambda k: final[k], default=None)
    if best is None or final[best] <= 0:
        return body
    top = known[best]
    if top.parent is None or not top.parent.tag:
        return top if texts.all[id(top)] >= LEAST_CONTENT else body
    taken = [c for c in top.parent.children if isinstance(c, Node) and (c is top or _belongs(c, final, texts, final[best], top))]
    out = top
    if len(taken) > 1:
        out = Node("div", {}, top.parent)
        out.children = taken
    return out if sum(texts.all[id(c)] for c in taken) >= LEAST_CONTENT else body


def _belongs(node: Node, final: dict[int, float], texts: _Texts, most: float, top: Node) -> bool:
    size, density = texts.all[id(node)], texts.density(node)
    if size == 0 or node.tag in UNWANTED or _prior(node) <= -25.0:
        return False
    same = node.attrs.get("class") == top.attrs.get("class") and (bool(node.attrs.get("class")) or node.tag == top.tag and node.tag in ("section", "article"))
    if final.get(id(node), 0.0) + (most / 5 if same else 0.0) >= max(10.0, most / 5):
        return True
    if node.tag in ("p", "blockquote"):
        return size > 80 and density < 0.25 or density == 0 and bool(re.search(r"[.!?]\s*$", node.text()))
    return node.tag in ("h1", "h2", "h3", "ul", "ol", "table", "pre") and density < 0.25


_BOUNDARY = object()
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "a": "a", "br": "br"}


def _pieces(node: Node, breaks: frozenset[str] = frozenset()) -> list:
    """What stands inside an element: Markdown of runs of text, and elements of ``breaks``, in order.

    ``_BOUNDARY`` stands where another block element begins or ends.
    """
    out: list[list] = [[]]
    open_marks: list[str] = []
    waiting: list = list(reversed(node.children))
    while waiting:
        item = waiting.pop()
        if isinstance(item, str) or item is _BOUNDARY:
            out[-1].append(item)
        elif isinstance(item, tuple):
            open_marks.pop()
            inner = out.pop()
            out[-1] += [_marked(item[0], "".join(inner))] if all(isinstance(x, str) for x in inner) else inner
        elif item.tag in breaks:
            out[-1].append(item)
        elif item.tag not in ("script", "style"):
            mark = _MARKS.get(item.tag, "")
            if mark and mark not in open_marks:  # one inside its like has no mark of its own
                out.append([])
                open_marks.append(mark)
                waiting.append((item,))
            elif item.tag in BLOCKS:
                out[-1].append(_BOUNDARY)
                waiting.append(_BOUNDARY)
            waiting += reversed(item.children)
    return out[0]


def inline(node: Node) -> str:
    """Markdown of what stands inside a block: links, emphasis, code; white space collapses, blocks are set apart by it."""
    return re.sub(r"\s+", " ", "".join(" " if x is _BOUNDARY else x for x in _pieces(node)))


def _runs(node: Node, breaks: frozenset[str], apart: bool) -> Iterator[str | Node]:
    """Runs of text that aren't blank, and elements of ``breaks``; ``apart``: other blocks end a run, else they are blanks."""
    held: list[str] = []
    for item in [*_pieces(node, breaks), None]:
        if isinstance(item, str):
            held.append(item)
        elif item is _BOUNDARY and not apart:
            held.append(" ")
        else:
            text = re.sub(r"\s+", " ", "".join(held)).strip()
            held = []
            if text:
                yield text
            if isinstance(item, Node):
                yield item


def _marked(node: Node, text: str) -> str:
    bare = re.sub(r"\s+", " ", text).strip()
    href = node.attrs.get("href", "").strip()
    if node.tag == "br":
        return " "
    if node.tag == "a" and bare and href and not is_dangerous(href):
        return f"[{bare}]({without_tracking(href)})"
    mark = _MARKS[node.tag]
    return f"{mark}{bare}{mark}" if bare and mark not in ("a", "br") else text


def _list(node: Node) -> Iterator[str | tuple[Node, str]]:
    """Lines of a list, and blocks inside its items with what their lines begin with."""
    number = 0
    for item in node.children:
        if isinstance(item, Node) and item.tag in ("ul", "ol"):
            yield item, "  "
            continue
        if isinstance(item, str):
            parts: Iterator[str | Node] = iter([" ".join(item.split())] if item.strip() else [])
        else:
            parts = _runs(item, _IN_BLOCKS, False)
        number += isinstance(item, Node) or bool(item.strip())
        prefix = f"{number}. " if node.tag == "ol" else "- "
        first, blank = True, " " * len(prefix)
        for part in parts:
            if isinstance(part, str):
                yield (prefix if first else blank) + part
            else:
                if first:
                    yield prefix.strip()
                yield part, blank
            first = False
        if first and isinstance(item, Node) and item.tag == "li":
            yield prefix.strip()


def _quote(node: Node) -> Iterator[str | tuple[Node, str]]:
    first = True
    for part in _runs(node, _IN_BLOCKS, True):
        if not first:
            yield ""
        yield part if isinstance(part, str) else (part, "")
        first = False


def _code(node: Node) -> tuple[str, str]:
    inner = node.find("code")
    names = " ".join(x.attrs.get("class", "") for x in (node, inner) if x)
    language = re.search(r"(?:language|lang|highlight)-([\w+#-]+)", names)
    parts, waiting = [], list(reversed(node.children))
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            parts.append(item)
        else:
            waiting += reversed(item.children)
    return "".join(parts).strip("\n"), language[1] if language else ""


def _rows(node: Node) -> list[list[Node]]:
    """Cells of a table's own rows; those of a table inside a cell are that cell's text."""
    out, waiting = [], list(reversed(node.children))
    while waiting:
        item = waiting.pop()
        if isinstance(item, Node) and item.tag == "tr":
            out.append([c for c in item.children if isinstance(c, Node) and c.tag in ("td", "th")])
        elif isinstance(item, Node) and item.tag != "table":
            waiting += reversed(item.children)
    return out


def _table(node: Node) -> list[str]:
    rows = _rows(node)
    width = max(map(len, rows), default=0)
    cells = [[inline(c).strip().replace("\\", "\\\\").replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    if rows and any(c.tag == "th" for c in rows[0]):
        lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
    return lines


def _lines(node: Node) -> Iterator[str | tuple[Node, str]]:
    """A block's lines of Markdown, and blocks inside it with what their lines begin with."""
    kind = BLOCK_TYPES[node.tag]
    if kind == "list":
        yield from _list(node)
    elif kind == "quote":
        yield from _quote(node)
    elif kind == "code":
        text, language = _code(node)
        fence = "`" * max(3, max(map(len, re.findall(r"`+", text)), default=0) + 1)
        yield from [f"{fence}{language}", *text.split("\n"), fence]
    elif kind == "table":
        yield from _table(node)
    else:
        text = inline(node).strip()
        yield f"{'#' * int(node.tag[1])} {text}" if kind == "heading" else text


def rendered(node: Node) -> str:
    """A block in Markdown. Blocks inside blocks wait on a stack, so depth has no bound but that of the indentation."""
    out: list[str] = []
    stack = [(_lines(node), "> " if BLOCK_TYPES[node.tag] == "quote" else "")]
    while stack:
        lines, prefix = stack[-1]
        item = next(lines, None)
        if item is None:
            stack.pop()
        elif isinstance(item, str):
            out.append(prefix + item if item else prefix.rstrip())
        else:
            inner, more = item
            more += "> " if BLOCK_TYPES[inner.tag] == "quote" else ""
            stack.append((_lines(inner), (prefix + more) if len(prefix) < MOST_INDENT else prefix))
    return "\n".join(out)


def block(node: Node) -> dict:
    """Type, level, text, Markdown and metadata of a block element."""
    kind, text, level, meta = BLOCK_TYPES[node.tag], node.text(), None, {"tag": node.tag, "rows": None, "columns": None, "language": None}
    if kind == "heading":
        level = int(node.tag[1])
    elif kind == "code":
        text, language = _code(node)
        meta["language"] = language or None
    elif kind == "table":
        rows = _rows(node)
        meta["rows"], meta["columns"] = len(rows), max(map(len, rows), default=0)
    markdown = rendered(node)
    return {"block_type": kind, "level": level, "text": text, "markdown": markdown, "metadata": meta, "structural_hash": hashlib.sha256(structure(markdown).encode()).hexdigest()}


def content(root: Node) -> list[dict | str]:
    """Block elements in order that aren't inside another, and between them Markdown of text that stands in no block."""
    out: list[dict | str] = []
    for part in _runs(root, frozenset(BLOCK_TYPES), True) if root.tag not in BLOCK_TYPES else [root]:
        if isinstance(part, str):
            out.append(part)
            continue
        found = block(part)
        if found["text"].strip() or found["block_type"] in ("table", "code"):
            out.append(found)
    return out


def blocks(root: Node) -> list[dict]:
    """Block elements in order that aren't inside another; text of none of them is left out, blank ones too."""
    return [x for x in content(root) if isinstance(x, dict)]


def structure(markdown: str) -> str:
    """What a Markdown text is built of: headings, list depths, closed fences, links; else its first characters."""
    out, depth = [], None
    lists: list[str] = []
    fence, closed = "", 0
    for line in markdown.split("\n"):
        heading = re.match(r"(#{1,6})\s+(.+)$", line)
        if heading:
            out.append(f"H{len(heading[1])}:" + re.sub(r"[^\w\s]", "", heading[2].strip().lower()))
        item = re.match(r"(\s*)[-*+]\s", line)
        if item:
            now = len(item[1].expandtabs(4)) // 4
            if now != depth:
                lists.append(f"LIST:{now}")
            depth = now
        elif line.strip():
            depth = None
        mark = re.match(r"`{3,}|~{3,}", line)
        if mark and not fence:
            fence = mark[0]
        elif mark and mark[0][0] == fence[0] and len(mark[0]) >= len(fence):
            fence, closed = "", closed + 1
    links = len(re.findall(r"(?<!!)\[[^\]]+\]\([^()]*(?:\([^()]*\)[^()]*)*\)", markdown))
    out += lists + ([f"CODE_BLOCKS:{closed}"] if closed else []) + ([f"LINKS:{links}"] if links else [])
    return "\n".join(out) or markdown[:200]


def hrefs(root: Node) -> list[str]:
    """What the anchors of a page link to, as it is written, in order."""
    return [n.attrs["href"] for n in root.nodes() if n.tag == "a" and n.attrs.get("href", "").strip()]


def base_href(root: Node) -> str:
    """The first address that a page declares as its base, as it is written; '' if none."""
    return next((n.attrs["href"] for n in root.nodes() if n.tag == "base" and "href" in n.attrs), "")
