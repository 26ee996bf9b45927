"""Packaged formats: notebooks, DOCX, ODT and EPUB, each read and written; image bytes go along by URL."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import zipfile
from functools import lru_cache
from urllib.parse import unquote
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from docloom.ast import DocumentError, attr, cells_of, document, el, relayered, table_node, text_of, trim, walk, words
from docloom.operators.writers import html_page, meta_texts, write_text
from docloom.sources.html import identifier, read_html
from docloom.sources.markdown import read_markdown
from docloom.sources.media import inspect

STAMP = (1980, 1, 1, 0, 0, 0)  # of every part, so that equal documents give equal packages


def zipped(parts: list[tuple[str, str | bytes]], stored_first: bool = False) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, content) in enumerate(parts):
            info = zipfile.ZipInfo(name, STAMP)
            info.compress_type = zipfile.ZIP_STORED if stored_first and i == 0 else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return data.getvalue()


class Package:
    """A ZIP's parts by name; media are read only when asked for."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError) as e:
            raise DocumentError(f"not a package: {e}") from None
        self.names = set(self.zip.namelist())

    def bytes(self, name: str) -> bytes | None:
        return self.zip.read(name) if name in self.names else None

    def xml(self, name: str) -> ET.Element | None:
        data = self.bytes(name)
        return None if data is None else element_of(data, name)

    def kids(self, name: str) -> list[ET.Element]:
        return below(self.xml(name))


def element_of(data: bytes, name: str) -> ET.Element:
    if b"<!ENTITY" in data:
        raise DocumentError(f"{name} declares entities")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise DocumentError(f"{name}: {e}") from None


def below(e: ET.Element | None) -> list[ET.Element]:
    return list(e) if e is not None else []


@lru_cache(4096)
def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def get(e: ET.Element, name: str, default: str = "") -> str:
    for k, v in e.attrib.items():
        if local(k) == name:
            return v
    return default


def kid(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if e is None:
            return None
        for k in e:
            if local(k.tag) == name:
                e = k
                break
        else:
            return None
    return e


# ---- notebooks


def read_notebook(data: bytes) -> tuple[dict, dict[str, bytes]]:
    """Cells as Divs: markdown parsed, code as a CodeBlock with its outputs, raw as a RawBlock."""
    try:
        book = json.loads(data)
        cells = book["cells"]
    except (ValueError, KeyError, TypeError) as e:
        raise DocumentError(f"not a notebook: {e}") from None
    lang = book.get("metadata", {}).get("kernelspec", {}).get("language") or book.get("metadata", {}).get("language_info", {}).get("name") or "python"
    joined = lambda s: s if isinstance(s, str) else "".join(s or [])
    out, media = [], {}
    for n, cell in enumerate(cells):
        kind, source = cell.get("cell_type"), joined(cell.get("source", ""))
        pairs = [] if cell.get("execution_count") is None else [("execution_count", str(cell["execution_count"]))]
        head = lambda k: attr(str(cell.get("id", "")), ["cell", k], pairs)  # noqa: E731, B023
        if kind == "markdown":
            for name, bundle in cell.get("attachments", {}).items():
                for value in bundle.values():
                    media[f"attachment:{n}/{name}"] = base64.b64decode(joined(value))
            inner = read_markdown(source, "markdown")["blocks"]
            for x in walk(inner):
                if x["t"] == "Image" and x["c"][2][0].startswith("attachment:"):
                    x["c"][2][0] = f"attachment:{n}/{x['c'][2][0][11:]}"
            out.append(el("Div", head("markdown"), inner))
        elif kind == "code":
            inner = [el("CodeBlock", attr("", [lang]), source)]
            inner += [x for o in cell.get("outputs", []) for x in output(o, media, joined)]
            out.append(el("Div", head("code"), inner))
        elif kind == "raw":
            fmt = cell.get("metadata", {}).get("raw_mimetype", cell.get("metadata", {}).get("format", "ipynb"))
            out.append(el("Div", head("raw"), [el("RawBlock", {"text/html": "html", "text/latex": "latex"}.get(fmt, fmt), source)]))
    meta = {"jupyter": el("MetaMap", {k: el("MetaString", json.dumps(book.get(k))) for k in ("metadata", "nbformat", "nbformat_minor")})}
    return document(out, meta), media


def output(o: dict, media: dict, joined) -> list:
    """A cell's output as one Div: of a bundle the richest kind counts, images first."""
    kind = o.get("output_type", "")
    if kind == "stream":
        return [el("Div", attr("", ["output", "stream", o.get("name", "stdout")]), [el("CodeBlock", attr(), joined(o.get("text", "")))])]
    if kind == "error":
        trace = re.sub(r"\x1b[^m]*m", "", "\n".join(o.get("traceback", [])))
        return [el("Div", attr("", ["output", "error"], [("ename", o.get("ename", "")), ("evalue", o.get("evalue", ""))]), [el("CodeBlock", attr(), trace)])]
    data = o.get("data", {})
    image = next((k for k in data if k.startswith("image/")), None)
    if image:
        raw = joined(data[image]).encode() if image.endswith("+xml") else base64.b64decode(joined(data[image]))
        name = f"{hashlib.sha1(raw).hexdigest()}.{image[6:].partition('+')[0]}"
        media[name] = raw
        inner = [el("Para", [el("Image", attr(), [], [name, ""])])]
    elif found := next((k for k in data if k.endswith("json")), None):
        inner = [el("CodeBlock", attr("", ["json"]), json.dumps(data[found]))]
    else:
        found = next((k for k in ("text/plain", "text/html", "text/latex", "text/markdown") if k in data), None)
        text = joined(data[found]) if found else ""
        inner = [el("CodeBlock", attr(), text) if found == "text/plain" else el("RawBlock", (found or "text/html")[5:], text)]
    return [el("Div", attr("", ["output", kind]), inner)]


def written_output(o: dict, media: dict[str, bytes], count: int | None) -> dict | None:
    """A cell's output of its Div; None of a block that is none."""
    if o["t"] != "Div" or "output" not in o["c"][0][1]:
        return None
    (_, classes, pairs), inner = o["c"]
    kind, lines = classes[1] if len(classes) > 1 else "display_data", lambda x: x.splitlines(keepends=True)
    if kind == "stream":
        return {"output_type": "stream", "name": classes[-1], "text": lines(text_of(inner))}
    if kind == "error":
        said = dict(map(tuple, pairs))
        return {"output_type": "error", "ename": said.get("ename", ""), "evalue": said.get("evalue", ""), "traceback": text_of(inner).split("\n")}
    block, data = inner[0] if inner else el("Para", []), {}
    image = block["c"][0]["c"][2][0] if lone_image(block) else ""
    if image in media:
        ext = image.rpartition(".")[2]
        data[f"image/{ext}" + "+xml" * (ext == "svg")] = media[image].decode("utf-8", "replace") if ext == "svg" else base64.b64encode(media[image]).decode()
    elif block["t"] == "RawBlock":
        data[f"text/{block['c'][0]}"] = lines(block["c"][1])
    elif block["t"] == "CodeBlock" and block["c"][0][1] == ["json"]:
        data["application/json"] = json.loads(block["c"][1])
    else:
        data["text/plain"] = lines(text_of(inner))
    return {"output_type": kind, "data": data, "metadata": {}} | ({"execution_count": count} if kind == "execute_result" else {})


def write_notebook(doc: dict, media: dict[str, bytes] | None = None) -> bytes:
    """nbformat 4.5: Divs of class cell become cells, with outputs, attachments and the metadata of the notebook that was
    read; other blocks become markdown cells."""
    cells, media = [], media or {}

    def add(kind, source, ident="", **more):
        ident = ident or hashlib.sha1(f"{len(cells)}:{source}".encode()).hexdigest()[:8]
        cells.append({"cell_type": kind, "id": ident, "metadata": {}, **more, "source": source.splitlines(keepends=True)})

    def markdown(blocks, ident=""):
        attached: dict = {}
        for x in walk(blocks):
            if x["t"] == "Image" and x["c"][2][0] in media and x["c"][2][0].startswith("attachment:"):
                name = x["c"][2][0].partition("/")[2]
                attached[name] = {media_type(media[x["c"][2][0]], name): base64.b64encode(media[x["c"][2][0]]).decode()}
                x["c"][2][0] = "attachment:" + name
        add("markdown", write_text(document(blocks), "gfm").rstrip("\n"), ident, **({"attachments": attached} if attached else {}))

    loose: list = []
    for b in [*doc["blocks"], None]:
        cell = b is not None and b["t"] == "Div" and "cell" in b["c"][0][1]
        if (cell or b is None) and loose:
            markdown(loose)
            loose = []
        if b is None:
            break
        if not cell:
            loose.append(b)
            continue
        (ident, classes, pairs), inner = b["c"]
        if "code" in classes:
            said = dict(map(tuple, pairs)).get("execution_count")
            count = int(said) if said else None
            outputs = [w for o in inner[1:] if (w := written_output(o, media, count))]
            add("code", inner[0]["c"][1] if inner else "", ident, execution_count=count, outputs=outputs)
        elif "raw" in classes:
            fmt, source = inner[0]["c"] if inner else ("ipynb", "")
            add("raw", source, ident)
            if fmt != "ipynb":
                cells[-1]["metadata"]["raw_mimetype"] = {"html": "text/html", "latex": "text/latex"}.get(fmt, fmt)
        else:
            markdown(inner, ident)
    kept = doc["meta"].get("jupyter", {}).get("c", {}).get("metadata", {}).get("c")
    metadata = json.loads(kept) if kept else None
    return (json.dumps({"cells": cells, "metadata": metadata or {}, "nbformat": 4, "nbformat_minor": 5}, ensure_ascii=False, indent=1) + "\n").encode()


# ---- DOCX

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_RUNS = (("i", "Emph"), ("b", "Strong"), ("smallCaps", "SmallCaps"), ("strike", "Strikeout"), ("u", "Underline"))


# Paragraph styles of metadata and of captions, by name.
_METADATA = {"title": "title", "subtitle": "subtitle", "author": "author", "date": "date", "abstract": "abstract"}
_CAPTIONS = {"caption", "table caption", "image caption"}


# Packages of one maker share these parts, so each of them is parsed once. What they return is only read.


@lru_cache(32)
def styles_of(data: bytes | None) -> dict[str, tuple[str, str]]:
    """(name, id of the style it is based on) by id of word/styles.xml."""
    val = lambda s, name: get(k, "val") if (k := kid(s, name)) is not None else ""
    return {get(s, "styleId"): (val(s, "name"), val(s, "basedOn")) for s in (element_of(data, "word/styles.xml") if data is not None else ()) if local(s.tag) == "style"}


@lru_cache(32)
def numbers_of(data: bytes | None) -> dict[str, dict]:
    """Levels' (format, start) by number of word/numbering.xml."""
    abstract, numbers = {}, {}
    for n in element_of(data, "word/numbering.xml") if data is not None else ():
        if local(n.tag) == "abstractNum":
            abstract[get(n, "abstractNumId")] = {get(v, "ilvl"): (get(kid(v, "numFmt"), "val") if kid(v, "numFmt") is not None else "bullet", int(get(kid(v, "start"), "val", "1")) if kid(v, "start") is not None else 1) for v in n if local(v.tag) == "lvl"}
        elif local(n.tag) == "num":
            levels = dict(abstract.get(get(kid(n, "abstractNumId"), "val"), {}))
            for o in n:
                if local(o.tag) == "lvlOverride" and (fresh := kid(o, "startOverride")) is not None:
                    levels[get(o, "ilvl")] = (levels.get(get(o, "ilvl"), ("bullet", 1))[0], int(get(fresh, "val", "1")))
            numbers[get(n, "numId")] = levels
    return numbers


class DocxReader:
    def __init__(self, data: bytes):
        self.package = Package(data)
        self.body = kid(self.package.xml("word/document.xml"), "body")
        if self.body is None:
            raise DocumentError("no word/document.xml")
        relations = lambda part: {get(r, "Id"): get(r, "Target") for r in self.package.kids(f"word/_rels/{part}.xml.rels")}
        self.rels = relations("document")
        self.styles = styles_of(self.package.bytes("word/styles.xml"))
        self.numbers = numbers_of(self.package.bytes("word/numbering.xml"))
        # a note's links and images are those of its own part
        self.notes = {}
        for kind, part in (("footnoteReference", "footnotes"), ("endnoteReference", "endnotes")):
            own = relations(part)
            self.notes |= {(kind, get(n, "id")): (n, own) for n in self.package.kids(f"word/{part}.xml")}
        self.open_notes: set[tuple[str, str]] = set()
        self.meta: dict = {}
        self.taken: dict[str, int] = {}
        self.used: set[str] = set()

    def style_names(self, ident: str) -> list[str]:
        """A style's name and those of the styles it is based on, nearest first, at most 16."""
        out = []
        for _ in range(16):
            if ident not in self.styles:
                break
            name, ident = self.styles[ident]
            out.append(name.lower())
        return out or ([ident.lower()] if ident else [])

    def caption_of(self, e) -> list | None:
        """A caption paragraph's inlines; None of others."""
        style = kid(e, "pPr", "pStyle") if local(e.tag) == "p" else None
        if style is None or not _CAPTIONS & set(self.style_names(get(style, "val"))):
            return None
        return trim(self.inlines(e))

    def blocks(self, nodes) -> list:
        out: list = []
        pending: list = []  # (level, numId, blocks)
        caption: list | None = None  # of the table or image that comes next
        nodes = list(nodes)
        for at, e in enumerate(nodes):
            name = local(e.tag)
            found = self.caption_of(e)
            if found is not None:
                out += self.lists(pending)
                pending = []
                ahead = local(nodes[at + 1].tag) if at + 1 < len(nodes) else ""
                if out and lone_image(out[-1]):
                    out[-1] = figure(out[-1], found)
                elif out and out[-1]["t"] == "Table" and not out[-1]["c"][1][1] and ahead != "tbl":
                    out[-1]["c"][1][1] = [el("Plain", found)]
                elif ahead == "tbl":
                    caption = found
                elif found:
                    out.append(el("Para", found))
                continue
            if name == "p":
                block, number = self.paragraph(e)
                if number and block:
                    pending.append((*number, block))
                    continue
                if pending:
                    out += self.lists(pending)
                    pending = []
                for b in block:
                    if out and b["t"] == out[-1]["t"] == "BlockQuote":
                        out[-1]["c"] += b["c"]
                    elif out and b["t"] == out[-1]["t"] == "CodeBlock":
                        out[-1]["c"][1] += "\n" + b["c"][1]
                    elif out and b["t"] == out[-1]["t"] == "DefinitionList":
                        term, bodies = b["c"][0]
                        if term:
                            out[-1]["c"] += b["c"]
                        else:
                            out[-1]["c"][-1][1] += bodies
                    elif b["t"] == "DefinitionList" and not b["c"][0][0]:  # no term before it
                        out += b["c"][0][1][0]
                    else:
                        out.append(b)
            elif name == "tbl":
                out += self.lists(pending)
                pending = []
                out.append(self.table(e))
                if caption is not None:
                    out[-1]["c"][1][1], caption = [el("Plain", caption)] if caption else [], None
            elif name in ("sdt", "sdtContent", "ins"):
                out += self.blocks(kid(e, "sdtContent") if kid(e, "sdtContent") is not None else e)
        return out + self.lists(pending)

    def lists(self, items: list) -> list:
        """Nested lists of flat (level, number id, blocks) paragraphs."""
        out, at = [], 0
        while at < len(items):
            level, num, _ = items[at]
            group: list = []
            while at < len(items) and (items[at][0] > level or items[at][:2] == (level, num)):
                if items[at][0] == level:
                    group.append([items[at][2]])
                    at += 1
                else:
                    start = at
                    while at < len(items) and items[at][0] > level:
                        at += 1
                    group[-1].append(self.lists(items[start:at]))
            fmt, start = self.numbers.get(num, {}).get(str(level), ("bullet", 1))
            done = [[b for part in item for b in part] for item in group]
            style = {"decimal": "Decimal", "lowerLetter": "LowerAlpha", "upperLetter": "UpperAlpha", "lowerRoman": "LowerRoman", "upperRoman": "UpperRoman"}.get(fmt)
            out.append(el("OrderedList", [start, el(style), el("Period")], done) if style else el("BulletList", done))
        return out

    def paragraph(self, p) -> tuple[list, tuple | None]:
        props = kid(p, "pPr")
        style = kid(props, "pStyle")
        names = self.style_names(get(style, "val")) if style is not None else []
        number = kid(props, "numPr")
        inner = trim(self.inlines(p))
        level = next((int(m[1]) for n in names if (m := re.fullmatch(r"heading (\d)", n))), None)
        if kid(props, "pBdr", "bottom") is not None and not inner:
            return [el("HorizontalRule")], None
        if level:
            base = identifier(text_of(inner))
            n = self.taken.get(base, 0)
            self.taken[base] = n + 1
            return [el("Header", level, attr(f"{base}-{n}" if n else base), inner)], None
        if {"source code", "sourcecode"} & set(names):
            return [el("CodeBlock", attr(), "".join("\n" if local(t.tag) == "br" else t.text or "" for t in p.iter() if local(t.tag) in ("t", "br")))], None
        if not inner:
            return [], None
        if names[:1] == ["definition term"]:
            return [el("DefinitionList", [[inner, []]])], None
        if names[:1] == ["definition"]:
            return [el("DefinitionList", [[[], [[el("Para", inner)]]]])], None
        if {"block text", "quote", "block quote", "intense quote"} & set(names):
            return [el("BlockQuote", [el("Para", inner)])], None
        block = [el("Plain" if "compact" in names else "Para", inner)]
        if number is not None:
            return block, (int(get(kid(number, "ilvl"), "val", "0")) if kid(number, "ilvl") is not None else 0, get(kid(number, "numId"), "val") if kid(number, "numId") is not None else "")
        return block, None

    def inlines(self, p) -> list:
        out: list = []
        for e in p:
            name = local(e.tag)
            if name == "r":
                out += self.run(e)
            elif name == "hyperlink":
                target = self.rels.get(get(e, "id"), "") or ("#" + get(e, "anchor") if get(e, "anchor") else "")
                out.append(el("Link", attr(), self.inlines(e), [target, ""]))
            elif name in ("ins", "smartTag", "sdt", "sdtContent"):
                out += self.inlines(e)
        return relayered(out)

    def run(self, r) -> list:
        inner: list = []
        props = kid(r, "rPr")
        for e in r:
            name = local(e.tag)
            if name == "t":
                inner += words(e.text or "", "Space")
            elif name == "tab":
                inner.append(el("Space"))
            elif name in ("br", "cr"):
                inner.append(el("LineBreak"))
            elif name in ("footnoteReference", "endnoteReference"):
                inner += self.note((name, get(e, "id")))
            elif name == "drawing":
                blip = next((x for x in e.iter() if local(x.tag) == "blip"), None)
                about = next((x for x in e.iter() if local(x.tag) == "docPr"), None)
                if blip is not None and (target := self.rels.get(get(blip, "embed"))):
                    self.used.add(target)
                    inner.append(el("Image", attr(), words(get(about, "descr")) if about is not None else [], [target, ""]))
        if not inner or props is None:
            return inner
        style = kid(props, "rStyle")
        if style is not None and "verbatim char" in self.style_names(get(style, "val")) + [get(style, "val").lower().replace("verbatimchar", "verbatim char")]:
            return [el("Code", attr(), text_of(inner))]
        on = lambda k: kid(props, k) is not None and get(kid(props, k), "val", "true") not in ("false", "0", "none")
        align = get(kid(props, "vertAlign"), "val") if kid(props, "vertAlign") is not None else ""
        if align in ("superscript", "subscript"):
            inner = [el(align.capitalize(), inner)]
        for key, kind in reversed(_RUNS):
            if on(key):
                inner = [el(kind, inner)]
        return inner

    def note(self, ident: tuple[str, str]) -> list:
        if ident in self.open_notes or ident not in self.notes:
            return []
        self.open_notes.add(ident)
        element, rels = self.notes[ident]
        outer, self.rels = self.rels, rels
        blocks = self.blocks(element)
        self.rels = outer
        self.open_notes.discard(ident)
        return [el("Note", blocks)]

    def leading(self, nodes: list) -> list:
        """The body after the paragraphs at its start whose styles make them metadata; a repeated author makes a list."""
        for i, e in enumerate(nodes):
            style = kid(e, "pPr", "pStyle") if local(e.tag) == "p" else None
            names = self.style_names(get(style, "val")) if style is not None else []
            field = next((_METADATA[n] for n in names if n in _METADATA), None)
            inner = trim(self.inlines(e)) if field else []
            if not field:
                return nodes[i:]
            if field == "abstract":
                before = self.meta.get(field, {"c": []})["c"]
                self.meta[field] = el("MetaBlocks", [*before, el("Para", inner)])
            elif inner:
                value = el("MetaInlines", inner)
                if field == "author" and field in self.meta:
                    had = self.meta[field]
                    value = el("MetaList", [*(had["c"] if had["t"] == "MetaList" else [had]), value])
                self.meta[field] = value
        return []

    def table(self, t) -> dict:
        rows, heads = [], 0
        for r in (x for x in t if local(x.tag) == "tr"):
            rows.append([(self.blocks(c), c) for c in r if local(c.tag) == "tc"])
            if kid(r, "trPr", "tblHeader") is not None and heads == len(rows) - 1:
                heads += 1
        span = lambda c: int(get(kid(c, "tcPr", "gridSpan"), "val", "1")) if kid(c, "tcPr", "gridSpan") is not None else 1
        width = max((sum(span(c) for _, c in r) for r in rows), default=0)
        grid, spans = [], {}
        for y, r in enumerate(rows):
            line, x = [], 0
            for blocks, c in r:
                merged = kid(c, "tcPr", "vMerge")
                if merged is not None and get(merged, "val", "continue") == "continue" and y:
                    top = next((k for k in range(y - 1, -1, -1) if (k, x) in spans), None)
                    if top is not None:
                        spans[top, x] = (y - top + 1, spans[top, x][1])
                else:
                    spans[y, x] = (1, span(c))
                    line.append((x, [el("Plain", b["c"]) if b["t"] == "Para" else b for b in blocks]))
                x += span(c)
            grid.append(line)
        by_cell = {(y, i): spans[y, x] for y, line in enumerate(grid) for i, (x, _) in enumerate(line)}
        cells = [[b for _, b in line] for line in grid]
        return table_node(cells[:heads], cells[heads:], ["AlignDefault"] * width, spans=by_cell)


def read_docx(data: bytes) -> tuple[dict, dict[str, bytes]]:
    reader = DocxReader(data)
    blocks = reader.blocks(reader.leading(list(reader.body)))
    media = {t: b for t in sorted(reader.used) if (b := reader.package.bytes("word/" + t)) is not None}
    return document(blocks, reader.meta), media


def lone_image(block: dict) -> bool:
    return block["t"] in ("Para", "Plain") and len(block["c"]) == 1 and block["c"][0]["t"] == "Image"


def figure(block: dict, caption: list) -> dict:
    """A Figure of an image paragraph and its caption."""
    return el("Figure", attr(), [None, [el("Plain", caption)] if caption else []], [el("Plain", block["c"])])


class DocxWriter:
    def __init__(self, media: dict[str, bytes]):
        self.media, self.rels, self.notes, self.lists, self.parts = media, [], [], [], []

    def rel(self, kind: str, target: str, external: bool = False) -> str:
        entry = (kind, target, external)
        if entry not in self.rels:
            self.rels.append(entry)
        return f"rId{self.rels.index(entry) + 10}"

    def p(self, inner: str, style: str = "", extra: str = "") -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{inner}</w:p>"

    def blocks(self, nodes, style="", extra="") -> str:
        return "".join(self.block(n, style, extra if i == 0 else "") for i, n in enumerate(nodes))

    def block(self, n, style="", extra="") -> str:
        t, c = n["t"], n.get("c")
        if t in ("Para", "Plain"):
            return self.p(self.runs(c), style or ("BodyText" if t == "Para" else "Compact"), extra)
        if t == "Header":
            return self.p(self.runs(c[2]), f"Heading{min(c[0], 9)}")
        if t == "CodeBlock":
            return "".join(self.p(self.text(line, '<w:rStyle w:val="VerbatimChar"/>'), "SourceCode") for line in c[1].split("\n"))
        if t == "BlockQuote":
            return self.blocks(c, "BlockText")
        if t in ("BulletList", "OrderedList"):
            return self.listing(t, c, 0)
        if t == "HorizontalRule":
            return self.p("", "", '<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr>')
        if t == "Table":
            out = self.blocks(c[1][1], "TableCaption") + '<w:tbl><w:tblPr><w:tblStyle w:val="Table"/></w:tblPr><w:tblGrid>' + "<w:gridCol/>" * len(c[2]) + "</w:tblGrid>"
            open_: dict[int, tuple[int, int]] = {}  # column: rows still under a tall cell, and its columns
            for section, _, cells in cells_of(c):
                head, line, x, cells = "<w:trPr><w:tblHeader/></w:trPr>" if section == "head" else "", "", 0, list(cells)
                while cells or x in open_:
                    if x in open_:
                        rows, wide = open_.pop(x)
                        if rows > 1:
                            open_[x] = (rows - 1, wide)
                        line += f"<w:tc><w:tcPr>{_grid_span(wide)}<w:vMerge/></w:tcPr>{self.p('')}</w:tc>"
                    else:
                        cell = cells.pop(0)
                        wide = max(1, cell[3])
                        if cell[2] > 1:
                            open_[x] = (cell[2] - 1, wide)
                        merge = '<w:vMerge w:val="restart"/>' if cell[2] > 1 else ""
                        line += f"<w:tc><w:tcPr>{_grid_span(wide)}{merge}</w:tcPr>{self.blocks(cell[4]) or self.p('')}</w:tc>"
                    x += wide
                out += f"<w:tr>{head}{line}</w:tr>"
            return out + "</w:tbl>" + self.p("")
        if t == "LineBlock":
            return self.p("<w:r><w:br/></w:r>".join(map(self.runs, c)))
        if t == "DefinitionList":
            return "".join(self.p(self.runs(term), "DefinitionTerm") + "".join(self.blocks(b, "Definition") for b in bodies) for term, bodies in c)
        if t == "Figure":
            return self.blocks(c[2], "CaptionedFigure") + self.blocks(c[1][1], "ImageCaption")
        return self.blocks(c[1], style) if t == "Div" else ""

    def listing(self, t, c, level) -> str:
        self.lists.append((t, c[0] if t == "OrderedList" else None, level))
        number = len(self.lists)
        out = ""
        for item in c if t == "BulletList" else c[1]:
            mark = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>'
            for b in item:
                if b["t"] in ("BulletList", "OrderedList"):
                    out += self.listing(b["t"], b["c"], min(level + 1, 8))
                else:
                    out += self.block(b, "", mark)
                    mark = ""
        return out

    def text(self, s: str, props: str = "") -> str:
        s = re.sub(r"[\x00-\x08\x0b-\x1f]", "", s)
        return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}<w:t xml:space=\"preserve\">{escape(s)}</w:t></w:r>"

    def runs(self, nodes, props="") -> str:
        out = ""
        marks = {"Emph": "<w:i/>", "Strong": "<w:b/>", "Strikeout": "<w:strike/>", "Underline": '<w:u w:val="single"/>', "SmallCaps": "<w:smallCaps/>", "Superscript": '<w:vertAlign w:val="superscript"/>', "Subscript": '<w:vertAlign w:val="subscript"/>'}
        plain: list[str] = []  # neighbouring text is one run
        for n in nodes:
            t, c = n["t"], n.get("c")
            if t == "Str":
                plain.append(c)
                continue
            if t in ("Space", "SoftBreak"):
                plain.append(" ")
                continue
            if plain:
                out += self.text("".join(plain), props)
                plain = []
            if t == "LineBreak":
                out += "<w:r><w:br/></w:r>"
            elif t in marks:
                out += self.runs(c, props + marks[t])
            elif t == "Code":
                out += self.text(c[1], '<w:rStyle w:val="VerbatimChar"/>' + props)
            elif t == "Math":
                out += self.text(f"${c[1]}$", props)
            elif t == "Link":
                place = f'w:anchor={quoteattr(c[2][0][1:])}' if c[2][0].startswith("#") else f'r:id="{self.rel("hyperlink", c[2][0], True)}"'
                out += f"<w:hyperlink {place}>{self.runs(c[1], props)}</w:hyperlink>"
            elif t == "Image":
                out += self.picture(c)
            elif t == "Note":
                self.notes.append("")
                at = len(self.notes)
                self.notes[at - 1] = self.blocks(c, "FootnoteText")
                out += f'<w:r><w:footnoteReference w:id="{at + 1}"/></w:r>'
            elif t == "Quoted":
                a, b = ("“", "”") if c[0]["t"] == "DoubleQuote" else ("‘", "’")
                out += self.text(a, props) + self.runs(c[1], props) + self.text(b, props)
            elif t in ("Span", "Cite"):
                out += self.runs(c[1], props)
        return out + self.text("".join(plain), props) if plain else out

    def picture(self, c) -> str:
        data = self.media.get(c[2][0])
        if data is None:
            return self.runs(c[1])
        name = f"media/{hashlib.sha1(data).hexdigest()[:16]}.{c[2][0].rpartition('.')[2][:4] or 'png'}"
        if ("word/" + name, data) not in self.parts:
            self.parts.append(("word/" + name, data))
        ident = self.rel("image", name)
        return f'<w:r><w:drawing><wp:inline><wp:extent cx="952500" cy="952500"/><wp:docPr id="1" name="Picture" descr={quoteattr(text_of(c[1]))}/><a:graphic><a:graphicData><pic:pic><pic:blipFill><a:blip r:embed="{ident}"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'


def _grid_span(n: int) -> str:
    return f'<w:gridSpan w:val="{n}"/>' if n > 1 else ""


_NS = f'xmlns:w="{_W}" xmlns:r="{_R}" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
_XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
# Style ids and names.
_STYLES = [("BodyText", "Body Text"), ("Compact", "Compact"), ("BlockText", "Block Text"), ("SourceCode", "Source Code"), ("DefinitionTerm", "Definition Term"), ("Definition", "Definition"), ("FootnoteText", "footnote text"), ("CaptionedFigure", "Captioned Figure"), ("ImageCaption", "Image Caption"), ("TableCaption", "Table Caption"), ("Title", "Title"), ("Subtitle", "Subtitle"), ("Author", "Author"), ("Date", "Date"), ("Abstract", "Abstract")]


def write_docx(doc: dict, media: dict[str, bytes] | None = None) -> bytes:
    w = DocxWriter(media or {})
    body = ""
    for field in ("title", "subtitle", "author", "date", "abstract"):
        value = doc["meta"].get(field)
        for one in value["c"] if value and value["t"] == "MetaList" else [value] if value else []:
            if one["t"] == "MetaBlocks":
                body += w.blocks(one["c"], field.capitalize())
            else:
                body += w.p(w.runs(one["c"]) if one["t"] == "MetaInlines" else w.text(str(one.get("c", ""))), field.capitalize())
    body += w.blocks(doc["blocks"])
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in [*_STYLES, *((f"Heading{k}", f"heading {k}") for k in range(1, 10))])
    styles += '<w:style w:type="character" w:styleId="VerbatimChar"><w:name w:val="Verbatim Char"/></w:style>'
    formats = {"Decimal": "decimal", "LowerAlpha": "lowerLetter", "UpperAlpha": "upperLetter", "LowerRoman": "lowerRoman", "UpperRoman": "upperRoman"}
    numbering = ""
    for i, (t, attrs, level) in enumerate(w.lists, 1):
        fmt, start = (formats.get(attrs[1]["t"], "decimal"), attrs[0]) if t == "OrderedList" else ("bullet", 1)
        numbering += f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="{level}"><w:start w:val="{start}"/><w:numFmt w:val="{fmt}"/></w:lvl></w:abstractNum>'
    numbering += "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i in range(1, len(w.lists) + 1))
    notes = "".join(f'<w:footnote w:id="{i + 2}">{n}</w:footnote>' for i, n in enumerate(w.notes))
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
    rels = "".join(f'<Relationship Id="rId{i}" Type="{kind}{k}" Target="{k}.xml"/>' for i, k in enumerate(("styles", "numbering", "footnotes"), 1))
    rels += "".join(f'<Relationship Id="rId{i + 10}" Type="{kind}{k}" Target={quoteattr(t)}{" TargetMode=\"External\"" if x else ""}/>' for i, (k, t, x) in enumerate(w.rels))
    pack = "http://schemas.openxmlformats.org/package/2006/"
    types = "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml"/>' for n, k in (("document", "document.main"), ("styles", "styles"), ("numbering", "numbering"), ("footnotes", "footnotes")))
    types += "".join(f'<Default Extension="{x}" ContentType="image/{x}"/>' for x in sorted({n.rpartition(".")[2] for n, _ in w.parts}))
    return zipped([
        ("[Content_Types].xml", f'{_XML}<Types xmlns="{pack}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>'),
        ("_rels/.rels", f'{_XML}<Relationships xmlns="{pack}relationships"><Relationship Id="rId1" Type="{kind}officeDocument" Target="word/document.xml"/></Relationships>'),
        ("word/document.xml", f"{_XML}<w:document {_NS}><w:body>{body}</w:body></w:document>"),
        ("word/_rels/document.xml.rels", f'{_XML}<Relationships xmlns="{pack}relationships">{rels}</Relationships>'),
        ("word/styles.xml", f"{_XML}<w:styles {_NS}>{styles}</w:styles>"), ("word/numbering.xml", f"{_XML}<w:numbering {_NS}>{numbering}</w:numbering>"),
        ("word/footnotes.xml", f"{_XML}<w:footnotes {_NS}>{notes}</w:footnotes>"), *w.parts,
    ])


# ---- ODT


def read_odt(data: bytes) -> tuple[dict, dict[str, bytes]]:
    package = Package(data)
    content = package.xml("content.xml")
    body = kid(content, "body", "text")
    if body is None:
        raise DocumentError("no content.xml")
    marks: dict[str, list[str]] = {}
    more = package.xml("styles.xml")
    named = {get(s, "name"): s for part in (more, content) if part is not None for s in part.iter() if local(s.tag) == "style"}

    def lineage(name: str) -> list[str]:
        """A style and those it is based on, nearest first, at most 16."""
        out: list[str] = []
        while name and name not in out and len(out) < 16:
            out.append(name)
            name = get(named[name], "parent-style-name") if name in named else ""
        return out

    def indented(name: str) -> bool:
        """Whether a paragraph style, or the nearest it is based on that says so, is set in by 5.5 mm or more."""
        for n in lineage(name):
            if n in named and (props := kid(named[n], "paragraph-properties")) is not None and get(props, "margin-left"):
                m = re.fullmatch(r"([\d.]+)(mm|cm|in|pt)", get(props, "margin-left"))
                return bool(m) and float(m[1]) * {"mm": 1, "cm": 10, "in": 25.4, "pt": 25.4 / 72}[m[2]] >= 5.5
        return False

    for s in named.values():
        if (props := kid(s, "text-properties")) is not None:
            found = [k for k, on in (("Emph", get(props, "font-style") == "italic"), ("Strong", get(props, "font-weight") == "bold"), ("Strikeout", get(props, "text-line-through-style") not in ("", "none")), ("Underline", get(props, "text-underline-style") not in ("", "none"))) if on]
            marks[get(s, "name")] = found
    ordered: dict[str, int] = {}  # starts of numbered list styles
    for part in (more, content):
        for s in part.iter() if part is not None else ():
            if local(s.tag) == "list-style" and (level := kid(s, "list-level-style-number")) is not None:
                ordered[get(s, "name")] = int(get(level, "start-value", "1") or 1)
    used: set[str] = set()

    def inlines(e) -> list:
        out = words(e.text or "")
        for k in e:
            name = local(k.tag)
            if name == "span":
                inner = inlines(k)
                if get(k, "style-name") == "Source_Text":
                    inner = [el("Code", attr(), text_of(inner))]
                for m in reversed(list(dict.fromkeys(m for n in lineage(get(k, "style-name")) for m in marks.get(n, [])))):
                    inner = [el(m, inner)]
                out += inner
            elif name == "s":
                out += [el("Space")]
            elif name == "line-break":
                out.append(el("LineBreak"))
            elif name == "a":
                out.append(el("Link", attr(), inlines(k), [re.sub(r"^\.\./", "", get(k, "href")), ""]))
            elif name == "note":
                out.append(el("Note", blocks(kid(k, "note-body"))))
            elif name == "frame" and kid(k, "image") is not None:
                used.add(get(kid(k, "image"), "href"))
                title = kid(k, "desc")
                out.append(el("Image", attr(), words(title.text or "") if title is not None else [], [get(kid(k, "image"), "href"), ""]))
            out += words(k.tail or "")
        return relayered(out)

    taken: dict[str, int] = {}
    numbered: dict[str, int] = {}  # the last number of each list style

    def blocks(parent, style="") -> list:
        out: list = []
        for e in parent if parent is not None else []:
            name = local(e.tag)
            if name == "h":
                inner = trim(inlines(e))
                base = identifier(text_of(inner))
                n = taken[base] = taken.get(base, -1) + 1
                out.append(el("Header", int(get(e, "outline-level", "1")), attr(f"{base}-{n}" if n else base), inner))
            elif name == "p":
                kind = get(e, "style-name")
                if kind == "Preformatted_20_Text":
                    code = "".join(e.itertext())
                    if out and out[-1]["t"] == "CodeBlock":
                        out[-1]["c"][1] += "\n" + code
                    else:
                        out.append(el("CodeBlock", attr(), code))
                elif kind == "Horizontal_20_Line":
                    out.append(el("HorizontalRule"))
                elif inner := trim(inlines(e)):
                    if "Quotations" in lineage(kind) or indented(kind):
                        if out and out[-1]["t"] == "BlockQuote":
                            out[-1]["c"].append(el("Para", inner))
                        else:
                            out.append(el("BlockQuote", [el("Para", inner)]))
                    else:
                        out.append(el("Plain" if kind == "Compact" else "Para", inner))
            elif name == "list":
                kind = get(e, "style-name") or style
                entries = [i for i in e if local(i.tag) == "list-item"]
                items = [blocks(i, kind) for i in entries]
                if kind in ordered:
                    said = get(entries[0], "start-value") if entries else ""
                    first = int(said) if said.isdigit() else numbered.get(kind, ordered[kind] - 1) + 1 if get(e, "continue-numbering") == "true" else ordered[kind]
                    numbered[kind] = first + len(items) - 1
                    out.append(el("OrderedList", [first, el("Decimal"), el("Period")], items))
                else:
                    out.append(el("BulletList", items))
            elif name == "table":
                heads = [r for h in e if local(h.tag) == "table-header-rows" for r in h]
                rows = [*heads, *(r for r in e if local(r.tag) == "table-row")]
                cells = [[[el("Plain", b["c"]) if b["t"] == "Para" else b for b in blocks(c)] for c in r if local(c.tag) == "table-cell"] for r in rows]
                width = max(map(len, cells), default=0)
                cells = [r + [[]] * (width - len(r)) for r in cells]
                out.append(table_node(cells[: len(heads)], cells[len(heads) :], ["AlignDefault"] * width))
            elif name == "section":
                out += blocks(e)
        return out

    found = blocks(body)
    return document(found), {u: b for u in sorted(used) if (b := package.bytes(u)) is not None}


def write_odt(doc: dict, media: dict[str, bytes] | None = None) -> bytes:
    media, styles, parts = media or {}, {}, []
    props = {"Emph": 'fo:font-style="italic"', "Strong": 'fo:font-weight="bold"', "Strikeout": 'style:text-line-through-style="solid"', "Underline": 'style:text-underline-style="solid"'}

    def text(s):
        s = escape(re.sub(r"[\x00-\x08\x0b-\x1f]", "", s))
        return re.sub(" {2,}", lambda m: f' <text:s text:c="{len(m[0]) - 1}"/>', s)

    def inlines(nodes, on=()):
        out = ""
        plain: list[str] = []  # neighbouring text is one span

        def flush():
            s = text("".join(plain))
            plain.clear()
            return f'<text:span text:style-name="{styles.setdefault(on, f"T{len(styles) + 1}")}">{s}</text:span>' if on and s else s

        for n in nodes:
            t, c = n["t"], n.get("c")
            if t in ("Str", "Space", "SoftBreak"):
                plain.append(c if t == "Str" else " ")
                continue
            out += flush() if plain else ""
            if t == "LineBreak":
                out += "<text:line-break/>"
            elif t in props:
                out += inlines(c, tuple(sorted({*on, t})))
            elif t in ("Superscript", "Subscript", "SmallCaps"):
                out += inlines(c, on)
            elif t in ("Code", "Math"):
                out += f'<text:span text:style-name="Source_Text">{text(c[1])}</text:span>'
            elif t == "Link":
                url = c[2][0] if re.match(r"[A-Za-z][\w+.-]*:|#|/", c[2][0]) else "../" + c[2][0]
                out += f"<text:a xlink:type=\"simple\" xlink:href={quoteattr(url)}>{inlines(c[1], on)}</text:a>"
            elif t == "Image" and c[2][0] in media:
                data = media[c[2][0]]
                name = f"Pictures/{hashlib.sha1(data).hexdigest()[:16]}.{c[2][0].rpartition('.')[2][:4]}"
                if (name, data) not in parts:
                    parts.append((name, data))
                out += f'<draw:frame><draw:image xlink:href="{name}"/><svg:desc>{text(text_of(c[1]))}</svg:desc></draw:frame>'
            elif t == "Note":
                out += f'<text:note text:note-class="footnote"><text:note-citation/><text:note-body>{blocks(c)}</text:note-body></text:note>'
            elif t == "Quoted":
                a, b = ("“", "”") if c[0]["t"] == "DoubleQuote" else ("‘", "’")
                out += a + inlines(c[1], on) + b
            elif t in ("Span", "Cite", "Image"):
                out += inlines(c[1], on)
        return out + flush() if plain else out

    def p(inner, style="Text_20_body"):
        return f'<text:p text:style-name="{style}">{inner}</text:p>'

    def blocks(nodes, style="Text_20_body"):
        out = ""
        for n in nodes:
            t, c = n["t"], n.get("c")
            if t in ("Para", "Plain"):
                out += p(inlines(c), "Compact" if t == "Plain" and style == "Text_20_body" else style)
            elif t == "Header":
                out += f'<text:h text:outline-level="{min(c[0], 10)}">{inlines(c[2])}</text:h>'
            elif t == "CodeBlock":
                out += "".join(p(text(x), "Preformatted_20_Text") for x in c[1].split("\n"))
            elif t == "BlockQuote":
                out += blocks(c, "Quotations")
            elif t in ("BulletList", "OrderedList"):
                items = c if t == "BulletList" else c[1]
                start = f' text:start-value="{c[0][0]}"' if t == "OrderedList" and c[0][0] != 1 else ""
                out += f'<text:list text:style-name="{"L1" if t == "BulletList" else "L2"}">' + "".join(f"<text:list-item{start if k == 0 else ''}>{blocks(i)}</text:list-item>" for k, i in enumerate(items)) + "</text:list>"
            elif t == "HorizontalRule":
                out += p("", "Horizontal_20_Line")
            elif t == "Table":
                rows = {True: "", False: ""}
                for section, _, cells in cells_of(c):
                    rows[section == "head"] += "<table:table-row>" + "".join(f"<table:table-cell>{blocks(x[4])}</table:table-cell>" for x in cells) + "</table:table-row>"
                head = f"<table:table-header-rows>{rows[True]}</table:table-header-rows>" if rows[True] else ""
                out += f'<table:table><table:table-column table:number-columns-repeated="{max(1, len(c[2]))}"/>{head}{rows[False]}</table:table>'
            elif t == "LineBlock":
                out += p("<text:line-break/>".join(map(inlines, c)))
            elif t == "DefinitionList":
                out += "".join(p(inlines(term)) + "".join(map(blocks, bodies)) for term, bodies in c)
            elif t == "Figure":
                out += blocks([*c[2], *c[1][1]])
            elif t == "Div":
                out += blocks(c[1], style)
        return out

    body = blocks(doc["blocks"])
    auto = "".join(f'<style:style style:name="{n}" style:family="text"><style:text-properties {" ".join(props[k] for k in on)}/></style:style>' for on, n in styles.items())
    auto += '<text:list-style style:name="L1"><text:list-level-style-bullet text:level="1" text:bullet-char="•"/></text:list-style><text:list-style style:name="L2"><text:list-level-style-number text:level="1" style:num-format="1"/></text:list-style>'
    base = "urn:oasis:names:tc:opendocument:xmlns:"
    ns = " ".join(f'xmlns:{k}="{base}{v}:1.0"' for k, v in (("office", "office"), ("text", "text"), ("table", "table"), ("style", "style"), ("draw", "drawing"), ("fo", "xsl-fo-compatible"), ("svg", "svg-compatible"))) + ' xmlns:xlink="http://www.w3.org/1999/xlink"'
    listed = "".join(f'<manifest:file-entry manifest:full-path="{n}" manifest:media-type="{m}"/>' for n, m in [("/", "application/vnd.oasis.opendocument.text"), ("content.xml", "text/xml"), *((n, "image/" + n.rpartition(".")[2]) for n, _ in parts)])
    return zipped([
        ("mimetype", "application/vnd.oasis.opendocument.text"), ("META-INF/manifest.xml", f'{_XML}<manifest:manifest xmlns:manifest="{base}manifest:1.0">{listed}</manifest:manifest>'),
        ("content.xml", f"{_XML}<office:document-content {ns}><office:automatic-styles>{auto}</office:automatic-styles><office:body><office:text>{body}</office:text></office:body></office:document-content>"), *parts,
    ], True)


# ---- EPUB


def read_epub(data: bytes) -> tuple[dict, dict[str, bytes]]:
    """Chapters in the order of the spine; a chapter starts with an empty paragraph that carries its file's name."""
    package = Package(data)
    container = package.xml("META-INF/container.xml")
    root = next((get(e, "full-path") for e in (container.iter() if container is not None else []) if local(e.tag) == "rootfile"), None)
    opf = package.xml(root) if root else None
    if opf is None:
        raise DocumentError("no package document")
    folder = root.rpartition("/")[0]
    inside = lambda href: f"{folder}/{unquote(href)}" if folder else unquote(href)
    manifest = {get(i, "id"): (get(i, "href"), get(i, "media-type")) for i in below(kid(opf, "manifest"))}
    meta: dict = {}
    for e in below(kid(opf, "metadata")):
        name, value = local(e.tag), (e.text or "").strip()
        if value and name in ("title", "creator", "language", "identifier", "date", "publisher", "subject", "description"):
            entry = el("MetaInlines", words(value))
            meta[name] = entry if name not in meta else el("MetaList", [entry, *(meta[name]["c"] if meta[name]["t"] == "MetaList" else [meta[name]])])
    blocks: list = []
    for ref in below(kid(opf, "spine")):
        href, kind = manifest.get(get(ref, "idref"), ("", ""))
        page = package.bytes(inside(href)) if "html" in kind else None
        if page is None or get(ref, "linear") == "no":
            continue
        file = href.rpartition("/")[2]
        inner = read_html(page.decode("utf-8", "replace"), ids=False)["blocks"]
        for n in walk(inner):
            if n["t"] == "Link" and "#" in n["c"][2][0] and ":" not in n["c"][2][0]:
                path, _, fragment = n["c"][2][0].rpartition("#")
                n["c"][2][0] = f"#{(path.rpartition('/')[2] or file)}_{fragment}"
            elif n["t"] in ("Header", "Div") and n["c"][1 if n["t"] == "Header" else 0][0]:
                a = n["c"][1 if n["t"] == "Header" else 0]
                a[0] = f"{file}_{a[0]}"
        blocks += [el("Para", [el("Span", attr(file), [])]), *inner]
    used = {n["c"][2][0] for n in walk(blocks) if n["t"] == "Image"}
    media = {u: b for u in sorted(used) if (b := package.bytes(inside(u.removeprefix("../")))) is not None}
    return document(blocks, meta), media


def chapters(blocks: list) -> list[list]:
    """Blocks split before each heading of level 1."""
    out: list[list] = [[]]
    for b in blocks:
        if b["t"] == "Header" and b["c"][0] == 1:
            out.append([])
        out[-1].append(b)
    return [c for c in out if c]


def media_type(data: bytes, name: str) -> str:
    """The media type that the bytes say; of unknown ones that of the name's ending."""
    found = inspect(data)
    kind = found.kind.lower() if found else name.rpartition(".")[2].lower()
    return "image/" + {"jpg": "jpeg", "svg": "svg+xml", "tif": "tiff"}.get(kind, kind)


def write_epub(doc: dict, media: dict[str, bytes] | None = None) -> bytes:
    title = text_of(doc["meta"].get("title", {}).get("c", [])) if doc["meta"].get("title", {}).get("t") == "MetaInlines" else "Untitled"
    parts, items, nav = [], [], []
    for n, chapter in enumerate(chapters(doc["blocks"]), 1):
        name = f"ch{n:03}.xhtml"
        head = text_of(chapter[0]["c"][2]) if chapter[0]["t"] == "Header" else title
        page = html_page(document(chapter)).replace("<html>", '<html xmlns="http://www.w3.org/1999/xhtml">')
        parts.append((f"EPUB/text/{name}", _XML + page))
        items.append((f"ch{n:03}", f"text/{name}", "application/xhtml+xml"))
        nav.append((f"text/{name}", head))
    for u, data in sorted((media or {}).items()):
        parts.append((f"EPUB/{u}", data))
        items.append((f"m{len(items)}", u, media_type(data, u)))
    ident = hashlib.sha256(json.dumps(doc, sort_keys=True).encode()).hexdigest()
    uid = f"urn:uuid:{ident[:8]}-{ident[8:12]}-{ident[12:16]}-{ident[16:20]}-{ident[20:32]}"
    manifest = "".join(f'<item id="{i}" href={quoteattr(h)} media-type="{m}"/>' for i, h, m in items)
    spine = "".join(f'<itemref idref="{i}"/>' for i, _, m in items if m.endswith("xhtml+xml"))
    links = "".join(f"<li><a href={quoteattr(h)}>{escape(t)}</a></li>" for h, t in nav)
    points = "".join(f'<navPoint id="p{n}" playOrder="{n}"><navLabel><text>{escape(t)}</text></navLabel><content src={quoteattr(h)}/></navPoint>' for n, (h, t) in enumerate(nav, 1))
    authors = "".join(f"<dc:creator>{escape(a)}</dc:creator>" for a in (meta_texts(doc["meta"]["author"]) if "author" in doc["meta"] else []))
    return zipped([
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", f'{_XML}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
        ("EPUB/content.opf", f'{_XML}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{uid}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>en</dc:language>{authors}</metadata><manifest><item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{manifest}</manifest><spine toc="ncx">{spine}</spine></package>'),
        ("EPUB/nav.xhtml", f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(title)}</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>'),
        ("EPUB/toc.ncx", f'{_XML}<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{uid}"/></head><docTitle><text>{escape(title)}</text></docTitle><navMap>{points}</navMap></ncx>'),
        *parts,
    ], True)
