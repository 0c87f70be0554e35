"""XML without loss: every node knows its span of the source, and an edit changes that span alone. No Spark in the parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from leafmill.plans.session import ship


class BadXml(ValueError):
    def __init__(self, what: str, source: str, at: int):
        line = source.count("\n", 0, at) + 1
        super().__init__(f"{what} at line {line}, column {at - source.rfind(chr(10), 0, at)}")


_NAME = r"[^\s<>/=\"'&!?]+"
_TOKEN = re.compile(rf"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<!DOCTYPE(?P<doctype>[^>\[]*)(?P<subset>\[)?>?|</(?P<end>{_NAME})\s*>|<(?P<start>{_NAME})(?P<attrs>(?:\s+{_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(?P<empty>/)?>|(?P<text>[^<]+)", re.DOTALL)
_ATTRIBUTE = re.compile(rf"\s+({_NAME})\s*=\s*(\"[^\"]*\"|'[^']*')")
_ENTITY = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z][\w.-]*);|&")
_KNOWN = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        e = m.group(1)
        if e is None:
            raise BadXml("a lone &", s, m.start())
        if e[0] == "#":
            return chr(int(e[2:], 16) if e[1] in "xX" else int(e[1:]))
        if e not in _KNOWN:
            raise BadXml(f"unknown entity {e}", s, m.start())
        return _KNOWN[e]

    return _ENTITY.sub(one, s) if "&" in s else s


def escape(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(s: str) -> str:
    out = s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    return out.replace("\t", "&#9;").replace("\n", "&#10;").replace("\r", "&#13;")


@dataclass
class Node:
    id: int
    parent: int  # -1: none
    depth: int
    kind: str  # element, text, cdata, other
    name: str | None
    start: int
    end: int
    head: int = 0  # of elements: where the start tag ends
    foot: int = 0  # and the end tag begins
    attrs: list[tuple[str, str, str, int, int]] = field(default_factory=list)  # name, raw value, quote, span of the value with its quotes
    children: list[int] = field(default_factory=list)


class Tree:
    def __init__(self, source: str, nodes: list[Node]):
        self.source, self.nodes = source, nodes

    def elements(self, name: str, under: int | None = None, local: bool = True) -> Iterator[Node]:
        """Elements of a name (without prefix) in document order, in the whole tree or under a node."""
        lo, hi = (0, len(self.source)) if under is None else (self.nodes[under].start, self.nodes[under].end)
        for n in self.nodes:
            if n.kind == "element" and lo <= n.start and n.end <= hi and n.id != under and (n.name.rsplit(":", 1)[-1] if local else n.name) == name:
                yield n

    def children(self, n: Node, name: str | None = None) -> list[Node]:
        kids = [self.nodes[c] for c in n.children if self.nodes[c].kind == "element"]
        return kids if name is None else [c for c in kids if c.name.rsplit(":", 1)[-1] == name]

    def child(self, n: Node | None, name: str) -> Node | None:
        return next(iter(self.children(n, name)), None) if n else None

    def attributes(self, n: Node) -> dict[str, str]:
        return {a[0]: unescape(a[1]) for a in n.attrs}

    def attribute(self, n: Node | None, name: str, default: str | None = None) -> str | None:
        """By name without prefix."""
        return next((unescape(a[1]) for a in n.attrs if a[0].rsplit(":", 1)[-1] == name), default) if n else default

    def value(self, n: Node) -> str:
        """All text under a node."""
        if n.kind == "text":
            return unescape(self.source[n.start : n.end])
        if n.kind == "cdata":
            return self.source[n.start + 9 : n.end - 3]
        return "".join(self.value(self.nodes[c]) for c in n.children)


def parse(source: str) -> Tree:
    nodes: list[Node] = []
    open_: list[Node] = []
    at, roots = 0, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise BadXml("not well formed", source, at)
        parent = open_[-1] if open_ else None
        end = m.end()
        if m["end"] is not None:
            if parent is None or parent.name != m["end"]:
                raise BadXml(f"</{m['end']}> closes nothing", source, at)
            parent.foot, parent.end = at, end
            open_.pop()
            at = end
            continue
        if m["subset"]:
            raise BadXml("a document type with rules of its own", source, at)
        kind = "element" if m["start"] is not None else "text" if m["text"] is not None else "cdata" if m["cdata"] is not None else "other"
        if kind in ("text", "cdata") and parent is None and source[at:end].strip("﻿ \t\r\n"):
            raise BadXml("text outside of the root", source, at)
        n = Node(len(nodes), parent.id if parent else -1, len(open_), kind, m["start"], at, end)
        nodes.append(n)
        if parent:
            parent.children.append(n.id)
        if kind == "element":
            roots += parent is None
            base = m.start("attrs")
            n.attrs = [(a[1], a[2][1:-1], a[2][0], base + a.start(2), base + a.end(2)) for a in _ATTRIBUTE.finditer(m["attrs"])]
            names = [a[0] for a in n.attrs]
            if len(set(names)) < len(names):
                raise BadXml("an attribute twice", source, at)
            n.head = n.foot = end
            if not m["empty"]:
                open_.append(n)
        elif kind == "text":
            unescape(source[at:end])
        at = end
    if open_:
        raise BadXml(f"<{open_[-1].name}> is not closed", source, len(source))
    if roots != 1:
        raise BadXml("not one root", source, 0)
    return Tree(source, nodes)


@dataclass(frozen=True)
class Edit:
    """A new value for an attribute (None: take it away), or without a name for an element's text."""

    node: int
    name: str | None
    value: str | None


def edited(tree: Tree, edits: list[Edit]) -> str:
    """The source with the edits; everything else byte for byte."""
    cuts: list[tuple[int, int, str]] = []
    for e in edits:
        n = tree.nodes[e.node]
        if e.name is None:
            if n.head == n.end:  # an empty tag opens up
                tag = tree.source[n.start : n.end].rstrip("/>").rstrip()
                cuts.append((n.start, n.end, f"{tag}>{escape(e.value or '')}</{n.name}>"))
            else:
                cuts.append((n.head, n.foot, escape(e.value or "")))
            continue
        old = next((a for a in n.attrs if a[0] == e.name), None)
        if old and e.value is not None:
            cuts.append((old[3], old[4], f'"{escape_attribute(e.value)}"'))
        elif old:
            begin = tree.source.rindex(e.name, n.start, old[3])
            while tree.source[begin - 1].isspace():
                begin -= 1
            cuts.append((begin, old[4], ""))
        elif e.value is not None:
            place = n.attrs[-1][4] if n.attrs else n.start + 1 + len(n.name)
            cuts.append((place, place, f' {e.name}="{escape_attribute(e.value)}"'))
    out, at = [], 0
    for s, e, new in sorted(cuts):
        out += [tree.source[at:s], new]
        at = e
    return "".join([*out, tree.source[at:]])


NODES = "doc string, name string, node int, parent int, depth int, kind string, element string, attrs array<struct<name:string,raw:string,quote:string>>, start long, end long, error string"


def nodes(parts: DataFrame) -> DataFrame:
    """One row for each node of each part (doc, name, content); a part that is not well formed gives one row with what is wrong and where."""
    ship(parts.sparkSession)
    attrs = pa.list_(pa.struct([("name", pa.string()), ("raw", pa.string()), ("quote", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), attrs, pa.int64(), pa.int64(), pa.string())
        for b in batches:
            for doc, name, content in zip(b.column("doc").to_pylist(), b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    tree = parse((content or b"").decode("utf-8"))
                    rows = [(doc, name, n.id, n.parent, n.depth, n.kind, n.name, [{"name": a[0], "raw": a[1], "quote": a[2]} for a in n.attrs], n.start, n.end, None) for n in tree.nodes]
                except (BadXml, UnicodeDecodeError) as e:
                    rows = [(doc, name, -1, None, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [f.strip().split(" ")[0] for f in ("doc", "name", "node", "parent", "depth", "kind", "element", "attrs", "start", "end", "error")])

    return parts.select("doc", "name", "content").mapInArrow(run, NODES)
