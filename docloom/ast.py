"""The typed document tree as plain JSON values: {"t": constructor, "c": content}, as pandoc's public JSON form has it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

API_VERSION = [1, 23, 1]
LEAVES = frozenset(("Str", "Space", "SoftBreak", "LineBreak", "Code", "Math", "CodeBlock", "RawBlock", "RawInline", "HorizontalRule", "Null"))


_TOKEN = re.compile(r"[ \t\r\n]+|[^ \t\r\n]+")


class DocumentError(ValueError):
    """A document that can't be read; it becomes a row's error, never a failed job."""


def el(kind: str, *content):
    if not content:
        return {"t": kind}
    return {"t": kind, "c": content[0] if len(content) == 1 else list(content)}


def attr(ident: str = "", classes=(), pairs=()) -> list:
    return [ident, list(classes), [list(p) for p in pairs]]


def document(blocks: list, meta: dict | None = None) -> dict:
    return {"pandoc-api-version": API_VERSION, "meta": meta or {}, "blocks": blocks}


def dumps(doc: dict) -> str:
    return json.dumps({"pandoc-api-version": doc["pandoc-api-version"], "meta": dict(sorted(doc["meta"].items())), "blocks": doc["blocks"]}, ensure_ascii=False, separators=(",", ":"))


def words(text: str, newline: str = "SoftBreak") -> list:
    """Str, Space and SoftBreak nodes of running text; a run of white space with a line end is one SoftBreak."""
    return [{"t": "Str", "c": t} if t[0] not in " \t\r\n" else {"t": newline if "\n" in t else "Space"} for t in _TOKEN.findall(text)]


def cells_of(table: list) -> Iterator[tuple[str, int, list]]:
    """(section, row, cells) of a Table's content."""
    at = 0
    for section, rows in [("head", table[3][1]), *(("body", [*b[2], *b[3]]) for b in table[4]), ("foot", table[5][1])]:
        for row in rows:
            yield section, at, row[1]
            at += 1


def kids(node: dict) -> list[tuple[str, list]]:
    """(role, nodes) for each slot of a node that holds nodes."""
    t = node["t"]
    if t in LEAVES:
        return []
    c = node["c"]
    match t:
        case "Para" | "Plain" | "Emph" | "Strong" | "Underline" | "Strikeout" | "Superscript" | "Subscript" | "SmallCaps":
            return [("content", c)]
        case "Header":
            return [("content", c[2])]
        case "BlockQuote" | "Note":
            return [("content", c)]
        case "Div" | "Span" | "Link" | "Image" | "Cite" | "Quoted":
            return [("alt" if t == "Image" else "content", c[1])]
        case "LineBlock":
            return [("line", line) for line in c]
        case "BulletList":
            return [("item", item) for item in c]
        case "OrderedList":
            return [("item", item) for item in c[1]]
        case "DefinitionList":
            return [x for term, bodies in c for x in [("term", term), *(("definition", b) for b in bodies)]]
        case "Figure":
            return [("caption", c[1][1]), ("content", c[2])]
        case "Table":
            return [("caption", c[1][1]), *((f"{section}_cell", cell[4]) for section, _, row in cells_of(c) for cell in row)]
    return []


def walk(nodes: list) -> Iterator[dict]:
    """Every node in document order."""
    for node in nodes:
        yield node
        for _, inner in kids(node):
            yield from walk(inner)


def tallies(nodes: list) -> tuple[dict[str, int], int]:
    """How many nodes of each kind there are, and how many levels they are nested in."""
    counts: dict[str, int] = {}
    levels, now = 0, nodes
    while now:
        levels += 1
        below: list = []
        for n in now:
            t = n["t"]
            counts[t] = counts.get(t, 0) + 1
            if t not in LEAVES:
                for _, inner in kids(n):
                    below += inner
        now = below
    return counts, levels


def rewrite(nodes: list, f: Callable[[list], list]) -> list:
    """Applies f to every list of nodes, inner lists first; nodes are changed in place."""
    for node in nodes:
        for _, inner in kids(node):
            inner[:] = rewrite(inner, f)
    return f(nodes)


def text_of(nodes: list) -> str:
    """Running text of nodes, in order; notes and raw content are left out."""
    out = []
    for n in nodes:
        t = n["t"]
        if t == "Str":
            out.append(n["c"])
        elif t in ("Space", "SoftBreak", "LineBreak"):
            out.append(" ")
        elif t in ("Code", "Math", "CodeBlock"):
            out.append(n["c"][1])
        elif t not in ("Note", "RawInline", "RawBlock"):
            out += [text_of(inner) for _, inner in kids(n)]
    return "".join(out)


def depth(nodes: list) -> int:
    """How many levels nodes are nested in, at least 1."""
    levels = 0
    while nodes:
        levels += 1
        nodes = [x for n in nodes if n["t"] not in LEAVES for _, inner in kids(n) for x in inner]
    return max(1, levels)


def merge(nodes: list) -> list:
    """Joins neighbouring Str nodes."""
    out: list = []
    last = None  # the Str that out ends with
    for n in nodes:
        if n["t"] != "Str":
            last = None
        elif last is not None:
            last = out[-1] = {"t": "Str", "c": last["c"] + n["c"]}
            continue
        elif not n["c"]:
            continue
        else:
            last = n
        out.append(n)
    return out


LAYERS = ("Emph", "Strong", "SmallCaps", "Strikeout", "Underline")


def relayered(nodes: list) -> list:
    """Neighbours that share formatting are wrapped once: of the wrappers at a place the one that reaches furthest is
    the outermost. Office formats store every run with all of its formatting, so without this wrappers would repeat."""
    if not any(n["t"] in LAYERS for n in nodes):
        return merge(nodes)

    def flat(ns, on):
        for n in ns:
            if n["t"] in LAYERS:
                yield from flat(n["c"], on if n["t"] in on else [*on, n["t"]])
            else:
                yield on, n

    def build(items):
        out, at = [], 0
        while at < len(items):
            on, node = items[at]
            if not on:
                out.append(node)
                at += 1
                continue
            def reach(m):  # noqa: E306
                end = at
                while end < len(items) and m in items[end][0]:
                    end += 1
                return end
            best = max(on, key=lambda m: (reach(m), -LAYERS.index(m)))
            end = reach(best)
            out.append(el(best, build([([m for m in o if m != best], n) for o, n in items[at:end]])))
            at = end
        return merge(out)

    return build(list(flat(nodes, [])))


def trim(nodes: list) -> list:
    start, stop = 0, len(nodes)
    while start < stop and nodes[start]["t"] in ("Space", "SoftBreak"):
        start += 1
    while stop > start and nodes[stop - 1]["t"] in ("Space", "SoftBreak"):
        stop -= 1
    return nodes[start:stop]


def table_node(head: list[list[list]], body: list[list[list]], aligns: list[str], caption: list | None = None, spans=None) -> dict:
    """A Table of cells that are lists of blocks; spans maps (row, column) over head and body to (rows, columns)."""
    def row(cells, at):
        return [attr(), [[attr(), el("AlignDefault"), *(spans or {}).get((at, i), (1, 1)), c] for i, c in enumerate(cells)]]

    rows = [row(r, i) for i, r in enumerate([*head, *body])]
    return el("Table", attr(), [None, caption or []], [[el(a), el("ColWidthDefault")] for a in aligns], [attr(), rows[: len(head)]], [[attr(), 0, [], rows[len(head) :]]], [attr(), []])
