"""Card extraction from landed HTML pages: the one Python step of the engine.

``html_cards`` is a ``mapInPandas`` over page rows (Arrow batches): each body
is parsed with the standard library's ``html.parser`` into a light element
tree (unclosed tags tolerated), containers are selected with a small CSS
subset, and each field spec turns into one output column.  Everything after
extraction (defaults, URL rules, drops) is Spark expressions.

Selector subset: simple selectors ``tag``, ``.class``, ``#id``, ``[attr]``
and their compounds (``li.result-card``, ``a[href]``), joined by the
descendant combinator (``nav li``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    attrs: dict
    parent: "Node | None" = None
    children: list = field(default_factory=list)
    cls: frozenset | None = None

    def __post_init__(self):
        if self.cls is None:
            self.cls = frozenset(self.attrs.get("class", "").split())

    def classes(self) -> list[str]:
        return sorted(self.cls)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur)
        self.cur.children.append(n)
        if tag not in VOID:
            self.cur = n

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:  # close it and anything left open inside
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


#: a tag or a text of plain markup: lower-case names, one space before each
#: attribute, double-quoted values with the usual references only
_PLAIN = re.compile(
    r'<(?:/([a-z][a-z0-9]*)|([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*="[^"<>&]*(?:&(?:amp|lt|gt|quot);[^"<>&]*)*")*))>|([^<]+)'
)
_ATTR = re.compile(r' ([a-z0-9-]+)="([^"]*)"')
#: elements whose text the parser reads by rules of its own
_RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp plaintext".split())


@lru_cache(maxsize=4096)
def _attributes(text_: str) -> tuple[dict, frozenset]:
    attrs = {k: unescape(v) for k, v in _ATTR.findall(text_)}
    return attrs, frozenset(attrs.get("class", "").split())


def _parse_plain(html: str) -> Node | None:
    """The tree of ``_Builder`` for markup that is plain throughout, read by
    one expression; None for any other."""
    root = cur = Node("#root", {})
    end, scan = 0, _PLAIN.scanner(html).match
    while (m := scan()) is not None:
        end = m.end()
        closed, tag, attrs, text_ = m.groups()
        if text_ is not None:
            cur.children.append(unescape(text_) if "&" in text_ else text_)
        elif tag is not None:
            if tag in _RAW:
                return None
            found, cls = _attributes(attrs)
            n = Node(tag, found, cur, [], cls)
            cur.children.append(n)
            if tag not in VOID:
                cur = n
        else:
            n = cur
            while n is not None and n.tag != closed:
                n = n.parent
            if n is not None and n.parent is not None:
                cur = n.parent
    return root if end == len(html) else None


def parse(html: str) -> Node:
    root = _parse_plain(html or "")
    if root is not None:
        return root
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)\]")


@lru_cache(maxsize=256)
def _compile(sel: str) -> tuple:
    steps = []
    for part in sel.split():
        tag, classes, ids, attrs = None, [], [], []
        pos = 0
        for m in _SIMPLE.finditer(part):
            if m.start() != pos:
                raise ValueError(f"unsupported selector {sel!r}")
            pos = m.end()
            t, c, i, a = m.groups()
            if t:
                tag = t.lower()
            elif c:
                classes.append(c)
            elif i:
                ids.append(i)
            else:
                attrs.append(a)
        if pos != len(part):
            raise ValueError(f"unsupported selector {sel!r}")
        steps.append((tag, frozenset(classes), tuple(ids), tuple(attrs)))
    return tuple(steps)


def _match(n: Node, step) -> bool:
    tag, classes, ids, attrs = step
    if tag and n.tag != tag:
        return False
    if classes and not classes <= n.cls:
        return False
    if ids and n.attrs.get("id") not in ids:
        return False
    return all(a in n.attrs for a in attrs)


def _descendants(n: Node) -> list[Node]:
    out, stack = [], [n]
    while stack:
        x = stack.pop()
        out.append(x)
        inner = [c for c in x.children if c.__class__ is Node]
        if inner:
            inner.reverse()
            stack += inner
    return out[1:]


def _likely(nodes: list[Node], step) -> list[Node]:
    """The nodes that one part of the selector leaves, for the whole test."""
    tag, classes, ids, attrs = step
    if classes:
        c = next(iter(classes))
        return [n for n in nodes if c in n.cls]
    if ids:
        return [n for n in nodes if n.attrs.get("id") == ids[0]]
    if attrs:
        return [n for n in nodes if attrs[0] in n.attrs]
    return [n for n in nodes if n.tag == tag] if tag else nodes


def select(root: Node, sel, nodes: list | None = None) -> list[Node]:
    """All descendants of ``root`` matching the selector, document order.
    ``nodes`` may pass the descendants already listed (one walk per card)."""
    steps = _compile(sel) if isinstance(sel, str) else sel
    out = []
    for n in _likely(nodes if nodes is not None else _descendants(root), steps[-1]):
        if not _match(n, steps[-1]):
            continue
        i, p = len(steps) - 2, n.parent
        while i >= 0 and p is not None and p is not root:
            if _match(p, steps[i]):
                i -= 1
            p = p.parent
        if i < 0:
            out.append(n)
    return out


def text(n: Node) -> str:
    """Each text node stripped, empty ones dropped, joined with nothing."""
    parts = []
    stack = [n]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            s = x.strip()
            if s:
                parts.append(s)
        elif x.tag not in ("script", "style"):
            stack.extend(reversed(x.children))
    return "".join(parts)


@dataclass(frozen=True)
class Field:
    """How one output column is read from a card.

    ``kind``: ``text`` (first element matching the first selector that
    matches anything), ``texts`` (texts of all matches, a list), ``attr``
    (attribute ``attr`` of the first match whose value contains ``contains``).
    """

    selectors: tuple[str, ...]
    kind: str = "text"
    attr: str | None = None
    contains: str | None = None


def _extract(card: Node, f: Field, nodes: list | None = None):
    if nodes is None:
        nodes = _descendants(card)
    if f.kind == "texts":
        return [text(x) for x in select(card, f.selectors[0], nodes)]
    for sel in f.selectors:
        found = select(card, sel, nodes)
        if f.kind == "attr":
            if f.contains is None:  # the first match only, like select_one
                found = found[:1]
            for x in found:
                v = x.attrs.get(f.attr)
                if v is not None and (f.contains is None or f.contains in v):
                    return v
            continue
        if found:
            return text(found[0])
    return None


def cards_schema(keys: T.StructType, fields: dict[str, Field]) -> T.StructType:
    cols = list(keys.fields) + [T.StructField("pos", T.IntegerType(), False)]
    for name, f in fields.items():
        t = T.ArrayType(T.StringType()) if f.kind == "texts" else T.StringType()
        cols.append(T.StructField(name, t, True))
    return T.StructType(cols)


def _cards_of(body: str, steps, fspecs) -> tuple[int, list[tuple]]:
    """How many containers a body has, and ``(pos, *fields)`` of each; a card
    whose extraction fails is skipped, not fatal."""
    found = select(parse(body), steps)
    out = []
    for pos, card in enumerate(found):
        try:
            nodes = _descendants(card)
            out.append((pos, *(_extract(card, f, nodes) for f in fspecs)))
        except Exception:  # noqa: BLE001 - a bad card is skipped
            continue
    return len(found), out


def html_cards(pages: DataFrame, container: str, fields: dict[str, Field], body: str = "body",
               keys: list[str] | None = None) -> DataFrame:
    """One row per ``container`` element of each page body: the page key
    columns, ``pos`` (0-based position of the card in its page) and one
    column per field."""
    keys = keys or [c for c in pages.columns if c != body]
    schema = cards_schema(T.StructType([pages.schema[k] for k in keys]), fields)
    steps, fspecs = _compile(container), list(fields.values())

    def run(batches):
        for pdf in batches:
            rows = [(*key, *card) for *key, text_ in pdf[[*keys, body]].itertuples(index=False, name=None)
                    for card in _cards_of(text_, steps, fspecs)[1]]
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return pages.select(*keys, body).mapInPandas(run, schema)


def page_cards(pages: DataFrame, container: str, fields: dict[str, Field], body: str = "body",
               keys: list[str] | None = None) -> DataFrame:
    """``html_cards`` with one row per page: the key columns, ``n_found``
    containers and the array ``cards`` of (pos, fields)."""
    keys = keys or [c for c in pages.columns if c != body]
    card = cards_schema(T.StructType([]), fields)
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("n_found", T.IntegerType()),
                           T.StructField("cards", T.ArrayType(card))])
    steps, fspecs, names = _compile(container), list(fields.values()), card.fieldNames()

    def run(batches):
        for pdf in batches:
            rows = []
            for *key, text_ in pdf[[*keys, body]].itertuples(index=False, name=None):
                n, cards = _cards_of(text_, steps, fspecs)
                rows.append((*key, n, [dict(zip(names, c)) for c in cards]))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return pages.select(*keys, body).mapInPandas(run, schema)
