"""Markdown in three dialects: CommonMark, GFM, and the extended one with metadata, attributes and definition lists."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from docloom.ast import DocumentError, attr, depth, document, el, merge, rewrite, table_node, text_of, trim

MOST_NESTED = 200

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_BULLET = re.compile(r"( {0,3})([-+*])(?=[ \t]|$)")
_ORDERED = re.compile(r"( {0,3})(\d{1,9})([.)])(?=[ \t]|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_LABEL = r"\[((?:[^\[\]\\]|\\.)+)\]"
_DEFINITION = re.compile(rf" {{0,3}}{_LABEL}:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*>|[^\s<]\S*)(?:(?:[ \t]*\n[ \t]*|[ \t]+)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?=\n|$)")
# Names of elements that start an HTML block.
_BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_TAG = r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)"
_HTML_BLOCKS = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf" {{0,3}}</?(?:{'|'.join(_BLOCK_NAMES.split())})(?:[\s>]|/>|$)", re.I), None),
    (re.compile(rf" {{0,3}}{_TAG}[ \t]*$"), None),
]
_INLINE_HTML = re.compile(rf"{_TAG}|<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_BARE = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+|[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+")
_STARTS = set("#*-_>`~<+0123456789")
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


@dataclass
class Dialect:
    name: str
    tables: bool = False
    strike: bool = False
    tasks: bool = False
    math: bool = False
    notes: bool = False
    ids: bool = False
    bare_links: bool = False
    attributes: bool = False
    definitions: bool = False
    scripts: bool = False
    metadata: bool = False
    link_classes: bool = False


_SHARED = dict(tables=True, strike=True, tasks=True, math=True, notes=True, ids=True)
DIALECTS = {
    "commonmark": Dialect("commonmark"),
    "gfm": Dialect("gfm", **_SHARED, bare_links=True),
    "markdown": Dialect("markdown", **_SHARED, attributes=True, definitions=True, scripts=True, metadata=True, link_classes=True),
}


@dataclass
class State:
    dialect: Dialect
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)
    notes: dict[str, list[str]] = field(default_factory=dict)
    parsed: dict[str, list] = field(default_factory=dict)
    inside_note: bool = False


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold().upper()


def unescaped(text: str) -> str:
    """Backslash escapes and entities of a destination, title or info string resolved."""
    return re.sub(r"\\([!-/:-@\[-`{-~])|(" + _ENTITY.pattern + ")", lambda m: m[1] or html.unescape(m[2]), text)


def preprocess(text: str) -> str:
    """Line ends as \\n, tabs as blanks up to 4-column stops, NUL as U+FFFD, and a line end at the end."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd").split("\n")
    text = "\n".join(line.expandtabs(4) for line in lines)
    return text if text.endswith("\n") or not text else text + "\n"


def read_markdown(text: str, dialect: str = "gfm") -> dict:
    """The document of a markdown text. Raises DocumentError if it nests deeper than MOST_NESTED."""
    state, meta = State(DIALECTS[dialect]), {}
    lines = preprocess(text.removeprefix("\ufeff")).split("\n")[:-1]
    if state.dialect.metadata and lines and lines[0].rstrip() == "---":
        lines, meta = front_matter(lines, state)
    try:
        raw = blocks_of(lines, state)
        blocks = [b for r in raw for b in finish(r, state)]
        if depth(blocks) > MOST_NESTED:
            raise DocumentError("nested too deeply")
    except RecursionError:
        raise DocumentError("nested too deeply") from None
    if state.dialect.ids:
        assign_ids(blocks)
    return document(blocks, meta)


def front_matter(lines: list[str], state: State) -> tuple[list[str], dict]:
    """The subset of YAML that is read: `key: scalar`, `key:` with `- item` lines, comments and blank lines."""
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip() in ("---", "...")), None)
    if end is None:
        return lines, {}
    meta, key = {}, None
    scalar = lambda s: el("MetaBool", s == "true") if s in ("true", "false") else el("MetaInlines", inlines_of(s.strip("\"'"), state))
    for n, line in enumerate(lines[1:end], 2):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"\s*- (.*)$", line):
            if key is None:
                raise DocumentError(f"metadata line {n} isn't supported")
            meta[key]["c"].append(scalar(m[1].strip()))
        elif m := re.match(r"([A-Za-z_][\w-]*):(?:\s+(.*))?$", line):
            value = (m[2] or "").strip()
            key, meta[m[1]] = (m[1], el("MetaList", [])) if not value else (None, scalar(value))
        else:
            raise DocumentError(f"metadata line {n} isn't supported")
    return lines[end + 1 :], meta


def indent_of(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def interrupts(line: str, state: State) -> bool:
    """Whether a line ends the paragraph before it."""
    if line.lstrip(" ")[:1] not in _STARTS:
        return False
    if _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or _FENCE.match(line) or any(start.match(line) for start, _ in _HTML_BLOCKS[:6]):
        return True
    m = _BULLET.match(line) or _ORDERED.match(line)
    return bool(m and line[m.end() :].strip() and (m.lastindex == 2 or m[2] == "1"))


def blocks_of(lines: list[str], state: State) -> list[tuple]:
    """Raw blocks (kind, ...) of lines; their inlines are parsed after all link definitions are known."""
    out: list[tuple] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif indent_of(line) >= 4:
            j = i
            while j < len(lines) and (not lines[j].strip() or indent_of(lines[j]) >= 4):
                j += 1
            code = [x[4:] for x in lines[i:j]]
            while code and not code[-1].strip():
                code.pop()
            out.append(("code", attr(), "\n".join(code)))
            i = j
        elif m := _FENCE.match(line):
            close = re.compile(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$")
            j = next((k for k in range(i + 1, len(lines)) if close.match(lines[k])), len(lines))
            body = [re.sub(rf"^ {{0,{len(m[1])}}}", "", x) for x in lines[i + 1 : j]]
            info = unescaped(m[3])
            if state.dialect.attributes and (a := re.fullmatch(r"\{(.*)\}", info)):
                out.append(("code", parsed_attributes(a[1]), "\n".join(body)))
            else:
                out.append(("code", attr("", info.split()[:1]), "\n".join(body)))
            i = j + 1
        elif m := _ATX.match(line):
            out.append(("header", len(m[1]), (m[2] or "").strip()))
            i += 1
        elif _RULE.match(line):
            out.append(("rule",))
            i += 1
        elif _QUOTE.match(line):
            i = quote(lines, i, state, out)
        elif _BULLET.match(line) or _ORDERED.match(line):
            i = listing(lines, i, state, out)
        elif state.dialect.notes and (m := _FOOTNOTE.match(line)):
            j, body = i + 1, [m[2]]
            while j < len(lines) and (indent_of(lines[j]) >= 4 or not lines[j].strip() or lines[j - 1].strip() and not interrupts(lines[j], state) and not _FOOTNOTE.match(lines[j])):
                body.append(lines[j][4:] if indent_of(lines[j]) >= 4 else lines[j])
                j += 1
            state.notes.setdefault(normal_label(m[1]), body)
            i = j
        elif found := next(((k, end) for k, (start, end) in enumerate(_HTML_BLOCKS) if start.match(line)), None):
            end, j = found[1], i
            while j < len(lines):
                if end and end.search(lines[j]):
                    j += 1
                    break
                if not end and not lines[j].strip():
                    break
                j += 1
            out.append(("html", "\n".join(lines[i:j])))
            i = j
        else:
            i = paragraph(lines, i, state, out)
    return out


def quote(lines: list[str], i: int, state: State, out: list) -> int:
    body, fenced = [], False
    while i < len(lines):
        if m := _QUOTE.match(lines[i]):
            body.append(lines[i][m.end() :])
        elif lines[i].strip() and body and body[-1].strip() and open_paragraph(body, state) and not interrupts(lines[i], state):
            body.append("    " * bool(_SETEXT.match(lines[i]) or indent_of(lines[i]) >= 4) + lines[i].lstrip())
        else:
            break
        i += 1
    out.append(("quote", blocks_of(body, state)))
    return i


def open_paragraph(body: list[str], state: State) -> bool:
    """Whether the last block of body is a paragraph that a lazy line may continue."""
    last = blocks_of(body, State(state.dialect))
    while last and last[-1][0] in ("quote", "list"):
        last = last[-1][1] if last[-1][0] == "quote" else last[-1][2][-1]
    return bool(last) and last[-1][0] == "para"


def listing(lines: list[str], i: int, state: State, out: list) -> int:
    """One list: items while the marker's kind stays the same."""
    kind, items, loose, start = None, [], False, 1
    while i < len(lines):
        line = lines[i]
        m = _BULLET.match(line) or _ORDERED.match(line)
        if not m or _RULE.match(line) or indent_of(line) >= 4:
            break
        now = m[2] if m.lastindex == 2 else m[3]
        if kind is not None and now != kind:
            break
        if kind is None:
            kind, start = now, 1 if m.lastindex == 2 else int(m[2])
        rest = line[m.end() :]
        pad = indent_of(rest)
        width = m.end() + (pad if rest.strip() and 1 <= pad <= 4 else 1)
        body = [line[width:] if rest.strip() else ""]
        i += 1
        blank_first = not rest.strip()
        while i < len(lines):
            text = lines[i]
            if not text.strip():
                if blank_first and len(body) == 1:
                    break
                body.append("")
            elif indent_of(text) >= width:
                body.append(text[width:])
            elif body[-1].strip() and not interrupts(text, state) and not _BULLET.match(text) and not _ORDERED.match(text) and open_paragraph(body, state):
                # set in as far as that, it goes on with the paragraph whatever it looks like
                body.append(("    " if indent_of(text) >= 4 else "") + text.lstrip())
            else:
                break
            i += 1
        trailing = 0
        while body and not body[-1].strip() and len(body) > 1:
            body.pop()
            trailing += 1
        parsed = blocks_of(body, state)
        items.append(parsed)
        follows = i < len(lines) and (n := _BULLET.match(lines[i]) or _ORDERED.match(lines[i])) and (n[2] if n.lastindex == 2 else n[3]) == kind and not _RULE.match(lines[i])
        loose = loose or bool(trailing and follows) or gap_between(body, state)
        if blank_first and len(body) == 1 and i < len(lines) and not lines[i].strip() and not follows:
            while i < len(lines) and not lines[i].strip():
                i += 1
            if not (i < len(lines) and (_BULLET.match(lines[i]) or _ORDERED.match(lines[i]))):
                break
            loose = True
    out.append(("list", (kind, start, loose), items))
    return i


def gap_between(body: list[str], state: State) -> bool:
    """Whether a blank line stands between two of an item's own blocks."""
    for at in range(1, len(body) - 1):
        if not body[at].strip():
            head = State(state.dialect)
            before, whole = blocks_of(body[:at], head), blocks_of(body, State(state.dialect))
            if len(before) < len(whole) and len(blocks_of(body[at:], State(state.dialect))) + len(before) == len(whole):
                return True
    return False


def paragraph(lines: list[str], i: int, state: State, out: list) -> int:
    start, d = i, state.dialect
    while i < len(lines) and lines[i].strip():
        if i > start:
            if (m := _SETEXT.match(lines[i])) and definitions(lines[start:i], State(d)):
                text = definitions(lines[start:i], state)
                out.append(("header", 1 if m[1][0] == "=" else 2, "\n".join(x.strip() for x in text)))
                return i + 1
            if d.tables and i == start + 1 and _DELIMITER.match(lines[i]) and "|" in lines[i - 1] + lines[i] and len(pipe_cells(lines[i - 1])) == len(pipe_cells(lines[i])):
                return table(lines, start, state, out)
            if d.definitions and re.match(r" {0,2}[:~] ", lines[i]):
                return definition_list(lines, start, state, out)
            if interrupts(lines[i], state):
                break
        i += 1
    if d.definitions and i == start + 1 and i + 1 < len(lines) and re.match(r" {0,2}[:~] ", lines[i + 1]):
        return definition_list(lines, start, state, out)
    if text := definitions(lines[start:i], state):
        out.append(("para", "\n".join(x.lstrip() for x in text).rstrip()))
    return i


def definitions(lines: list[str], state: State) -> list[str]:
    """lines without the link definitions that they start with, which go into state."""
    text = "\n".join(lines)
    while m := _DEFINITION.match(text):
        if not normal_label(m[1]) or state.dialect.notes and m[1].startswith("^"):
            break
        url = m[2][1:-1] if m[2].startswith("<") else m[2]
        state.refs.setdefault(normal_label(m[1]), (unescaped(url), unescaped(m[3][1:-1]) if m[3] else ""))
        text = text[m.end() :].removeprefix("\n")
    return [x for x in text.split("\n")] if text.strip() else []


def pipe_cells(line: str) -> list[str]:
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def table(lines: list[str], i: int, state: State, out: list) -> int:
    head, marks = pipe_cells(lines[i]), pipe_cells(lines[i + 1])
    aligns = [{(1, 1): "AlignCenter", (1, 0): "AlignLeft", (0, 1): "AlignRight", (0, 0): "AlignDefault"}[m.startswith(":"), m.endswith(":")] for m in marks]
    rows, i = [], i + 2
    while i < len(lines) and lines[i].strip() and not interrupts(lines[i], state):
        cells = pipe_cells(lines[i])
        rows.append((cells + [""] * len(head))[: len(head)])
        i += 1
    out.append(("table", aligns, head, rows))
    return i


def definition_list(lines: list[str], i: int, state: State, out: list) -> int:
    entries = []
    while i < len(lines):
        term, j = lines[i], i + 1
        loose = j < len(lines) and not lines[j].strip()
        j += loose
        bodies = []
        while j < len(lines) and (m := re.match(r" {0,2}[:~] +", lines[j])):
            body, width = [lines[j][m.end() :]], m.end()
            j += 1
            while j < len(lines) and (indent_of(lines[j]) >= width or not lines[j].strip() or body[-1].strip() and not re.match(r" {0,2}[:~] ", lines[j])):
                if not lines[j].strip() and not any(indent_of(x) >= width and x.strip() for x in lines[j + 1 : j + 2]):
                    break
                body.append(lines[j][min(width, indent_of(lines[j])) :])
                j += 1
            bodies.append(blocks_of(body, state))
            if j < len(lines) and not lines[j].strip() and j + 1 < len(lines) and re.match(r" {0,2}[:~] ", lines[j + 1]):
                j += 1
        if not bodies:
            break
        entries.append((term, loose, bodies))
        i = j
        ahead = j
        while ahead < len(lines) and not lines[ahead].strip():
            ahead += 1
        after = ahead + 1 + (ahead + 1 < len(lines) and not lines[ahead + 1].strip())
        if ahead >= len(lines) or after >= len(lines) or not re.match(r" {0,2}[:~] ", lines[after]):
            break
        i = ahead
    out.append(("definitions", entries))
    return i


def finish(raw: tuple, state: State, tight: bool = False) -> list[dict]:
    """Tree blocks of a raw block."""
    kind = raw[0]
    if kind == "para":
        return [el("Plain" if tight else "Para", inlines_of(raw[1], state))]
    if kind == "header":
        text, a = raw[2], attr()
        if state.dialect.attributes and (m := re.search(r"[ \t]*\{([^{}]*)\}$", text)):
            text, a = text[: m.start()], parsed_attributes(m[1])
        return [el("Header", raw[1], a, inlines_of(text, state))]
    if kind == "rule":
        return [el("HorizontalRule")]
    if kind == "code":
        return [el("CodeBlock", raw[1], raw[2])]
    if kind == "html":
        return [el("RawBlock", "html", raw[1])]
    if kind == "quote":
        return [el("BlockQuote", [b for r in raw[1] for b in finish(r, state)])]
    if kind == "table":
        cell = lambda t: [el("Plain", found)] if (found := inlines_of(t, state)) else []
        return [table_node([[cell(c) for c in raw[2]]], [[cell(c) for c in r] for r in raw[3]], raw[1])]
    if kind == "definitions":
        return [el("DefinitionList", [[inlines_of(t, state), [[x for r in b for x in finish(r, state, not loose)] for b in bodies]] for t, loose, bodies in raw[1]])]
    (mark, start, loose), items = raw[1], raw[2]
    done = [[b for r in item for b in finish(r, state, not loose)] for item in items]
    if mark in ".)":
        return [el("OrderedList", [start, el("Decimal"), el("Period" if mark == "." else "OneParen")], done)]
    if not state.dialect.tasks:
        return [el("BulletList", done)]
    out: list = []
    for item in done:  # a list ends where items with and without a box meet
        boxed = task(item)
        if out and out[-1][0] == boxed:
            out[-1][1].append(item)
        else:
            out.append((boxed, [item]))
    return [el("BulletList", group) for _, group in out]


def task(item: list) -> bool:
    """Turns a leading [ ] or [x] of an item into a box; whether there was one."""
    if not item or item[0]["t"] not in ("Plain", "Para"):
        return False
    first = item[0]["c"]
    head = "".join(n.get("c", " ") if n["t"] in ("Str", "Space") else "\0" for n in first[:4])
    m = re.match(r"\[([ xX])\] ", head)
    if not m:
        return False
    used = 0
    while first and used < 4:
        used += len(first[0].get("c", " "))
        first.pop(0)
    first[:0] = [el("Str", "☐" if m[1] == " " else "☒"), el("Space")]
    return True


def parsed_attributes(text: str) -> list:
    ident, classes, pairs = "", [], []
    for m in re.finditer(r"#([^\s}]+)|\.([^\s}]+)|([\w:-]+)=(?:\"([^\"]*)\"|'([^']*)'|([^\s}]*))", text):
        if m[1]:
            ident = m[1]
        elif m[2]:
            classes.append(m[2])
        else:
            pairs.append((m[3], next(x for x in (m[4], m[5], m[6], "") if x is not None)))
    return attr(ident, classes, pairs)


def slug(text: str) -> str:
    """A heading's id: lower case, letters, digits, - and _ kept, each blank a -."""
    return "".join("-" if c.isspace() else c for c in text.lower() if c.isspace() or c in "-_" or unicodedata.category(c)[0] in "LN")


def assign_ids(blocks: list) -> None:
    """Gives every heading without an id its slug; later equal ones get -1, -2 and so on."""
    taken: dict[str, int] = {}

    def visit(nodes):
        for n in nodes:
            if n["t"] == "Header" and not n["c"][1][0]:
                base = slug(text_of(n["c"][2]))
                seen = taken.get(base, 0)
                n["c"][1][0] = f"{base}-{seen}" if seen else base
                taken[base] = seen + 1
        return nodes

    rewrite(blocks, visit)


@dataclass
class Run:
    """A run of delimiters that may open or close emphasis."""

    mark: str
    count: int
    opens: bool
    closes: bool
    total: int
    single: str


def inlines_of(text: str, state: State) -> list:
    """Nodes of a paragraph's text."""
    if not state.dialect.bare_links and _plain_run(state.dialect.name).fullmatch(text):
        return trim(plain_nodes(text))
    return spaced(parse_inlines(text, state))


def spaced(nodes: list) -> list:
    return trim(merge(nodes))


def flanking(text: str, start: int, end: int) -> tuple[bool, bool]:
    before, after = text[start - 1] if start else " ", text[end] if end < len(text) else " "
    punct = lambda c: c in _PUNCTUATION or unicodedata.category(c)[0] in "PS"
    left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
    right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
    if text[start] == "_":
        return left and (not right or punct(before)), right and (not left or punct(after))
    return left, right


_TOKEN = re.compile("[^ \\n]+|[ \\n]+")
_GAPS = {" ": "Space", "\n": "SoftBreak"}


def plain_nodes(text: str) -> list:
    """Nodes of text without marks."""
    return [{"t": kind} if (kind := _GAPS.get(t)) else {"t": "Str", "c": t} if t[0] not in " \n" else gap_of(t) for t in _TOKEN.findall(text)]


def gap_of(gap: str) -> dict:
    """The node of a run of blanks and line ends: two blanks before a line end make it hard."""
    return {"t": "LineBreak" if "\n" in gap and gap.startswith("  ") else "SoftBreak" if "\n" in gap else "Space"}


@lru_cache
def _plain_run(dialect: str) -> re.Pattern:
    """Characters that mean nothing by themselves in a dialect, blanks and line ends among them."""
    d = DIALECTS[dialect]
    marks = "~" * (d.strike or d.scripts) + "$" * d.math + "^" * d.scripts
    return re.compile(rf"[^\\`*_\[\]!<&{re.escape(marks)}]+")


def parse_inlines(text: str, state: State) -> list:
    d = state.dialect
    out: list = []  # nodes, Run objects, and ("[", image, place) markers
    i, n = 0, len(text)
    plain = _plain_run(d.name)
    while i < n:
        c = text[i]
        if m := plain.match(text, i):
            out += plain_nodes(m[0])
            i = m.end()
            if i == n and out[-1]["t"] == "LineBreak":
                out[-1] = el("SoftBreak")
        elif c == "\\":
            if i + 1 < n and text[i + 1] == "\n":
                out.append(el("LineBreak"))
                i += 2
                while i < n and text[i] == " ":
                    i += 1
            elif i + 1 < n and text[i + 1] in _PUNCTUATION:
                out.append(el("Str", text[i + 1]))
                i += 2
            else:
                out.append(el("Str", c))
                i += 1
        elif c == "`":
            m = re.compile("`+").match(text, i)
            close = re.compile(rf"(?<!`){m[0]}(?!`)").search(text, m.end())
            if close:
                code = text[m.end() : close.start()].replace("\n", " ")
                if code.strip(" ") and code[0] == code[-1] == " ":
                    code = code[1:-1]
                out.append(el("Code", attr(), code))
                i = close.end()
            else:
                out.append(el("Str", m[0]))
                i = m.end()
        elif c == "$" and (m := re.compile(r"\$\$([\s\S]+?)\$\$|\$(?=\S)((?:[^$\\]|\\[\s\S])*?)(?<=\S)\$(?!\d)").match(text, i)):
            out.append(el("Math", el("DisplayMath" if m[1] else "InlineMath"), m[1] or m[2]))
            i = m.end()
        elif c in "*_~^" and not (c == "~" and not (d.strike or d.scripts)):
            j = i
            while j < n and text[j] == c:
                j += 1
            opens, closes = flanking(text, i, j)
            if c in "~^" and not usable(c, j - i, d):
                out.append(el("Str", text[i:j]))
            else:
                single = {"^": "Superscript", "~": "Subscript" if d.scripts else "Strikeout"}.get(c, "Emph")
                out.append(Run(c, j - i, opens, closes, j - i, single))
            i = j
        elif c == "<" and (m := _AUTOLINK.match(text, i)):
            url = m[1] or "mailto:" + m[2]
            kind = [] if not d.link_classes else ["uri" if m[1] else "email"]
            out.append(el("Link", attr("", kind), [el("Str", m[1] or m[2])], [url, ""]))
            i = m.end()
        elif c == "<" and (m := _INLINE_HTML.match(text, i)):
            out.append(el("RawInline", "html", m[0]))
            i = m.end()
        elif c == "&" and (m := _ENTITY.match(text, i)) and (found := html.unescape(m[0])) != m[0]:
            out.append(el("Str", found if found != "\0" else "\ufffd"))
            i = m.end()
        elif c == "!" and text.startswith("![", i):
            out.append(["[", True, i + 2, True])
            i += 2
        elif c == "[":
            m = re.compile(r"\[\^([^\]\s]+)\]").match(text, i)
            if d.notes and m and normal_label(m[1]) in state.notes:
                out.append(note(normal_label(m[1]), state))
                i = m.end()
            else:
                out.append(["[", False, i + 1, True])
                i += 1
        elif c == "]":
            i = closed(text, i, out, state)
        else:
            out.append(el("Str", c))
            i += 1
    nodes = emphasis([el("Str", "![" if x[1] else "[") if type(x) is list else x for x in out])
    return with_bare_links(nodes, d) if d.bare_links else nodes


def usable(mark: str, count: int, d: Dialect) -> bool:
    return d.scripts and count == 1 or mark == "~" and d.strike and count in ((2,) if d.scripts else (1, 2))


def note(label: str, state: State) -> dict:
    """A footnote's node; notes inside a note resolve to nothing."""
    if state.inside_note:
        return el("Str", "")
    inner = State(state.dialect, state.refs, state.notes, state.parsed, True)
    return el("Note", [b for r in blocks_of(state.notes[label], inner) for b in finish(r, inner)])


def closed(text: str, i: int, out: list, state: State) -> int:
    """Handles a ] at i: a link or image if its opener has a destination or a known label, else plain text."""
    at = next((k for k in range(len(out) - 1, -1, -1) if isinstance(out[k], list)), None)
    if at is None:
        out.append(el("Str", "]"))
        return i + 1
    _, image, start, active = out[at]
    if not active:
        out[at] = el("Str", "[")
        out.append(el("Str", "]"))
        return i + 1
    target, end = destination(text, i + 1)
    if target is None:
        m = re.compile(_LABEL).match(text, i + 1)
        label = m[1] if m else text[start:i]
        if m or "[" not in text[start:i].replace("\\[", ""):
            target = state.refs.get(normal_label(label))
        end = m.end() if m else i + 3 if text.startswith("[]", i + 1) else i + 1
        if target is None:
            out[at] = el("Str", "![" if image else "[")
            out.append(el("Str", "]"))
            return i + 1
    inner = spaced(emphasis(out[at + 1 :]))
    del out[at:]
    out.append(el("Image" if image else "Link", attr(), inner, list(target)))
    if not image:
        for x in out:
            if isinstance(x, list) and not x[1]:
                x[3] = False
    return end


def destination(text: str, i: int) -> tuple[tuple[str, str] | None, int]:
    """((url, title), end) of a parenthesised destination at i, else (None, i)."""
    if i >= len(text) or text[i] != "(":
        return None, i
    space = re.compile(r"[ \n]*")
    j = space.match(text, i + 1).end()
    if j < len(text) and text[j] == "<":
        m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, j)
        if not m:
            return None, i
        url, j = m[1], m.end()
    else:
        level, k = 0, j
        while k < len(text) and text[k] > " ":
            if text[k] == "\\" and k + 1 < len(text) and text[k + 1] in _PUNCTUATION:
                k += 1
            elif text[k] == "(":
                level += 1
            elif text[k] == ")":
                if not level:
                    break
                level -= 1
            k += 1
        if level:
            return None, i
        url, j = text[j:k], k
    title, k = "", space.match(text, j).end()
    if k > j and (m := re.compile(r"\"((?:[^\"\\]|\\[\s\S])*)\"|'((?:[^'\\]|\\[\s\S])*)'|\(((?:[^()\\]|\\[\s\S])*)\)").match(text, k)):
        title, k = m[1] or m[2] or m[3] or "", space.match(text, m.end()).end()
    if k < len(text) and text[k] == ")":
        return (unescaped(url), unescaped(title)), k + 1
    return None, i


_WRAPS = {"*": "Strong", "_": "Strong", "~": "Strikeout"}


def emphasis(nodes: list) -> list:
    """Pairs delimiter runs: each closer with the nearest opener of its mark, longer wrappers first."""
    if not any(type(x) is Run for x in nodes):
        return nodes
    nodes = list(nodes)
    at = 0
    while at < len(nodes):
        run = nodes[at]
        if not isinstance(run, Run) or not run.closes:
            at += 1
            continue
        back = None
        for k in range(at - 1, -1, -1):
            o = nodes[k]
            if isinstance(o, Run) and o.mark == run.mark and o.opens:
                odd = (o.closes or run.opens) and (o.total + run.total) % 3 == 0 and (o.total % 3 or run.total % 3)
                if run.mark in "~^" and o.count != run.count or run.mark in "*_" and odd:
                    continue
                back = k
                break
        if back is None:
            at += 1
            continue
        opener = nodes[back]
        use = run.count if run.mark in "~^" else 2 if opener.count >= 2 and run.count >= 2 else 1
        inner = [el("Str", x.mark * x.count) if isinstance(x, Run) else x for x in nodes[back + 1 : at]]
        kind = run.single if use == 1 else _WRAPS[run.mark]
        opener.count -= use
        run.count -= use
        put = ([opener] if opener.count else []) + [el(kind, merge(inner))] + ([run] if run.count else [])
        nodes[back : at + 1] = put
        at = back + len(put) - (1 if run.count else 0)
    return [el("Str", x.mark * x.count) if isinstance(x, Run) else x for x in nodes]


def with_bare_links(nodes: list, d: Dialect) -> list:
    """Turns URLs and addresses in running text into links, outside of links."""
    out = []
    for n in merge(nodes):
        if n["t"] != "Str":
            if n["t"] in ("Emph", "Strong", "Strikeout"):
                n = el(n["t"], with_bare_links(n["c"], d))
            out.append(n)
            continue
        text, at = n["c"], 0
        for m in _BARE.finditer(text):
            found = m[0].rstrip("?!.,:*_~'\"")
            while found.endswith(")") and found.count(")") > found.count("("):
                found = found[:-1]
            if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "/@") or len(found) < 5:
                continue
            url = found if "://" in found else "http://" + found if found.startswith("www.") else "mailto:" + found
            out += [el("Str", text[at : m.start()])] if m.start() > at else []
            out.append(el("Link", attr(), [el("Str", found)], [url, ""]))
            at = m.start() + len(found)
        out += [el("Str", text[at:])] if at < len(text) else []
    return out
