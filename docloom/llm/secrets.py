"""Secrets in texts: single patterns, and credentials whose parts stand apart."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_append, arrow_map

# The base patterns, by kind, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "part_id", "part_secret", "part_endpoint")

# Parts too weak to report alone.
PART_ID = re.compile(r"(?<![A-Za-z0-9])(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9])[A-Z0-9]{16,}(?![A-Za-z0-9])")
PART_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])")
PART_ENDPOINT = re.compile(r"(?a:\b(?:https?|s3|ftp|jdbc:[a-z]+|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b)")

_KEYWORD = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, leftmost non-overlapping per kind, in code points, end exclusive."""
    out = []
    if _KEYWORD.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _near(spans: list[tuple[str, int, int]], starts: list[int], longest: int, start: int, end: int, scope: int) -> bool:
    """Whether a span (spans sorted by start) lies within scope of [start, end)."""
    lo, hi = bisect_left(starts, start - scope - longest), bisect_right(starts, end + scope)
    return any(e >= start - scope and not (s < end and start < e) for _, s, e in spans[lo:hi])


def linked_parts(text: str, base: list[tuple[str, int, int]], scope: int) -> list[tuple[str, int, int]]:
    """Weak parts that an interval join within scope code points confirms.

    An identifier or an endpoint is reported if a secret part (weak, or a base span) stands within scope of it; a weak
    secret if an identifier or an endpoint does. A part that overlaps a base span isn't reported again.
    """
    endpoints = [("part_endpoint", m.start(), m.end()) for m in PART_ENDPOINT.finditer(text)] if "://" in text or text.count(".") > 2 else []
    ids = [("part_id", m.start(), m.end()) for m in PART_ID.finditer(text)]
    secrets = [("part_secret", m.start(), m.end()) for m in PART_SECRET.finditer(text)]
    access = [x for x in base if x[0] == "access"]
    strong = [x for x in base if x[0] != "access"]
    if not (endpoints or ids or secrets):
        return []
    out = []
    order = lambda x: x[1]
    left, right = sorted([*endpoints, *ids, *access], key=order), sorted([*secrets, *strong], key=order)
    for parts, others in (([*ids, *endpoints], right), (secrets, left)):
        starts, longest = [s for _, s, _ in others], max([e - s for _, s, e in others], default=0)
        out += [p for p in parts if others and _near(others, starts, longest, p[1], p[2], scope)]
    taken = sorted(base, key=order)
    starts, longest = [s for _, s, _ in taken], max([e - s for _, s, e in taken], default=0)
    free = lambda p: not any(e > p[1] for _, _, e in taken[bisect_left(starts, p[1] - longest) : bisect_left(starts, p[2])])
    return [p for p in out if free(p)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    """text with each stretch of overlapping spans replaced by mask."""
    out, at, open_to = [], 0, -1
    for _, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start < open_to:
            at = open_to = max(open_to, end)
            continue
        out += [text[at:start], mask]
        at = open_to = end
    return "".join([*out, text[at:]])


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 240, mask: str = "[SECRET]", with_text: bool = True) -> DataFrame:
    """Per row: id, base_spans and spans (arrays of kind, start, end), redacted (text with spans masked; null stays).

    Null text has no spans. Rows with null ids and repeated rows stay, a row each; other columns aren't looked at; an
    empty table gives an empty result. Whole texts are read. with_text=False leaves redacted out.
    """

    def rows(columns):
        base_all, spans_all, redacted = [], [], []
        for text in columns[1]:
            base = base_spans(text) if text else []
            spans = sorted(base + linked_parts(text, base, scope), key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if text else []
            shape = lambda xs: [{"kind": k, "start": s, "end": e} for k, s, e in xs]
            base_all.append(shape(sorted(base, key=lambda x: (x[1], KINDS.index(x[0])))))
            spans_all.append(shape(spans))
            if with_text:
                redacted.append(masked(text, spans, mask) if spans else text)
        return [columns[0], base_all, spans_all, *([redacted] if with_text else [])]

    kind, span = df.schema[id_col].dataType.simpleString(), "array<struct<kind:string,start:long,end:long>>"
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), rows, f"`{id_col}` {kind}, base_spans {span}, spans {span}" + ", redacted string" * with_text)


def redact_rows(df: DataFrame, text_col: str = "text", scope: int = 240, mask: str = "[SECRET]") -> DataFrame:
    """df, every column kept, its text with all spans of find_secrets() masked, and changed: whether it had any (a
    column of that name is replaced; other names may clash with none). Null and empty texts stay, as do null ids and
    repeated rows; whole texts are read, however long; an empty table gives an empty result."""

    def values(texts):
        out = []
        for text in texts:
            spans = base_spans(text) if text else []
            spans = spans + linked_parts(text, spans, scope) if text else []
            out.append((masked(text, spans, mask) if spans else text, bool(spans)))
        return [[t for t, _ in out], [c for _, c in out]]

    names = [c for c in df.columns if c != "changed"]
    fresh = "masked_text"
    while fresh in names:
        fresh += "_"
    found = arrow_append(df.drop("changed"), text_col, values, f"`{fresh}` string, changed boolean")
    return found.select(*[F.col(f"`{fresh}`").alias(c) if c == text_col else F.col(f"`{c}`") for c in names], "changed")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of the base spans' list, and the list of all spans."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, n("assign"), n("access"), n("hex"), F.sha2(text("base_spans"), 256).alias("base_sha256"), text("spans").alias("spans"))
