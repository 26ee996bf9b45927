"""HTML pages: a forgiving tree builder and the map from elements to document nodes."""

from __future__ import annotations

import base64
import html
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

from docloom.ast import DocumentError, attr, document, el, merge, text_of, trim, words

MOST_NESTED = 200
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style head title meta link textarea noscript".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption colgroup".split()
)
# An open element on the left ends when one of the right starts inside it.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary", "legend", "figcaption", "colgroup"} | {"li", "dd", "dt"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
FENCES = {"table", "ul", "ol", "dl", "td", "th", "div", "section", "article", "body", "blockquote"}


@dataclass
class Element:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list = field(default_factory=list)  # of Element and str

    def find(self, name: str):
        """Elements of that name below, in document order."""
        for k in self.kids:
            if isinstance(k, Element):
                if k.name == name:
                    yield k
                yield from k.find(name)

    def all(self):
        """Elements below, in document order."""
        for k in self.kids:
            if isinstance(k, Element):
                yield k
                yield from k.all()

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def markup(self) -> str:
        """The element as XML."""
        given = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
        inner = "".join(html.escape(k, False) if isinstance(k, str) else k.markup() for k in self.kids)
        return f"<{self.name}{given}>{inner}</{self.name}>"


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in reversed(attrs)}
        if tag == "html":
            self.root.attrs |= given
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].name
            if tag in CLOSED_BY.get(name, ()):
                del self.open[at:]
            elif name in FENCES:
                break
        node = Element(tag, given)
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)
            if len(self.open) > MOST_NESTED:
                raise DocumentError("nested too deeply")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name == tag:
                del self.open[at:]
                return
            if self.open[at].name in ("table", "td", "th") and tag not in BLOCKS:
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def tree(text: str) -> Element:
    builder = Builder()
    builder.feed(text.replace("\0", "�"))
    builder.close()
    return builder.root


def attributes(e: Element, but=()) -> list:
    pairs = [(k.removeprefix("data-"), v) for k, v in e.attrs.items() if k not in ("id", "class", *but)]
    return attr(e.attrs.get("id", ""), e.attrs.get("class", "").split(), pairs)


WRAPS = {"em": "Emph", "i": "Emph", "strong": "Strong", "b": "Strong", "del": "Strikeout", "s": "Strikeout", "strike": "Strikeout", "ins": "Underline", "u": "Underline", "sup": "Superscript", "sub": "Subscript"}


def hoisted(kind: str, inner: list) -> list:
    """A wrapper without white space at its edges, which moves outside."""
    start, stop = 0, len(inner)
    while start < stop and inner[start]["t"] in ("Space", "SoftBreak"):
        start += 1
    while stop > start and inner[stop - 1]["t"] in ("Space", "SoftBreak"):
        stop -= 1
    return [*inner[:start], *([el(kind, inner[start:stop])] if stop > start else []), *inner[stop:]]


NOTES = "doc-endnotes"  # the role of what holds a page's notes


def goes_back(e: Element) -> bool:
    """Whether an element is the link from a note to its reference."""
    return e.attrs.get("role") == "doc-backlink" or "footnote-back" in e.attrs.get("class", "").split()


class Reader:
    def __init__(self, ids: bool, notes: dict[str, Element] | None = None):
        self.ids, self.taken, self.quotes = ids, {}, 0
        self.notes, self.inside = notes or {}, False

    def note(self, name: str) -> dict:
        """The Note of a reference. Its body is read on its own; references inside it stay links."""
        other = Reader(self.ids)
        other.inside = True
        return el("Note", other.blocks(self.notes[name].kids, "Plain"))

    def inlines(self, nodes: list) -> list:
        out: list = []
        for n in nodes:
            out += words(n) if isinstance(n, str) else self.inline(n)
        return self.tidy(out)

    def tidy(self, nodes: list) -> list:
        out: list = []
        for n in merge(nodes):
            gap = n["t"] in ("Space", "SoftBreak")
            if gap and out and out[-1]["t"] in ("Space", "SoftBreak", "LineBreak"):
                if n["t"] == "SoftBreak" and out[-1]["t"] == "Space":
                    out[-1] = n
                continue
            if n["t"] == "LineBreak" and out and out[-1]["t"] in ("Space", "SoftBreak"):
                out.pop()
            out.append(n)
        return out

    def inline(self, e: Element) -> list:
        name = e.name
        if name in DROPPED:
            return []
        if name in WRAPS:
            return hoisted(WRAPS[name], self.inlines(e.kids))
        if name == "br":
            return [el("LineBreak")]
        if name in ("code", "tt", "var", "samp", "kbd") and name != "kbd":
            classes = {"var": ["variable"], "samp": ["sample"]}.get(name, [])
            a = attributes(e)
            return [el("Code", [a[0], [*classes, *a[1]], a[2]], re.sub(r"[ \t\r\n]+", " ", e.text()).strip())]
        if name in ("abbr", "dfn", "kbd", "mark", "small"):
            a = attributes(e)
            return [el("Span", [a[0], [name, *a[1]], a[2]], self.inlines(e.kids))]
        if self.inside and goes_back(e):
            return []
        if name == "a" and e.attrs.get("role") == "doc-noteref" and e.attrs.get("href", "")[1:] in self.notes:
            return [self.note(e.attrs["href"][1:])]
        if name == "svg":
            return [el("Image", attr(), [], ["data:image/svg+xml;base64," + base64.b64encode(e.markup().encode()).decode(), ""])]
        if name == "a":
            if "href" in e.attrs:
                return [el("Link", attributes(e, ("href", "title")), self.inlines(e.kids), [e.attrs["href"], e.attrs.get("title", "")])]
            return [el("Span", attributes(e), self.inlines(e.kids))]
        if name == "img":
            return [el("Image", attributes(e, ("src", "alt", "title")), words(e.attrs.get("alt", "")), [e.attrs.get("src", ""), e.attrs.get("title", "")])]
        if name == "q":
            kind = "DoubleQuote" if self.quotes % 2 == 0 else "SingleQuote"
            self.quotes += 1
            inner = self.inlines(e.kids)
            self.quotes -= 1
            return [el("Quoted", el(kind), inner)]
        if name in ("span", "bdo"):
            if e.attrs.get("class", "").split() == ["smallcaps"]:
                return [el("SmallCaps", self.inlines(e.kids))]
            return [el("Span", attributes(e), self.inlines(e.kids))]
        if name == "input" and e.attrs.get("type") == "checkbox":
            return [el("Str", "☒" if "checked" in e.attrs else "☐"), el("Space")]
        inner = self.inlines(e.kids)
        return [el("SoftBreak"), *inner, el("SoftBreak")] if name in BLOCKS else inner

    def holds_blocks(self, e: Element) -> bool:
        return any(isinstance(k, Element) and (k.name in BLOCKS or k.name not in DROPPED and self.holds_blocks(k)) for k in e.kids)

    def blocks(self, nodes: list, loose: str = "Para") -> list:
        """Blocks of mixed content; running text between them becomes `loose` blocks."""
        out: list = []
        run: list = []

        def flush():
            if run:
                inner = trim(self.inlines(run))
                run.clear()
                if inner:
                    out.append(el(loose, inner))

        for n in nodes:
            if isinstance(n, Element) and (n.name in BLOCKS or n.name not in DROPPED and self.holds_blocks(n)):
                flush()
                out += self.block(n)
            elif isinstance(n, str) or n.name not in DROPPED:
                run.append(n)
        flush()
        return out

    def block(self, e: Element) -> list:
        name = e.name
        if e.attrs.get("role") == NOTES and not self.inside:
            return []
        if name == "p":
            inner = trim(self.inlines(e.kids))
            return [el("Para", inner)] if inner else []
        if re.fullmatch("h[1-6]", name):
            inner = trim(self.inlines(e.kids))
            a = attributes(e)
            if not a[0] and self.ids:
                a[0] = self.unique(identifier(text_of(inner)))
            return [el("Header", int(name[1]), a, inner)]
        if name == "blockquote":
            return [el("BlockQuote", self.blocks(e.kids))]
        if name in ("ul", "ol"):
            items = [self.item(k) for k in e.kids if isinstance(k, Element) and k.name not in DROPPED]
            if name == "ul":
                return [el("BulletList", items)]
            style = {"a": "LowerAlpha", "A": "UpperAlpha", "i": "LowerRoman", "I": "UpperRoman", "1": "Decimal"}.get(e.attrs.get("type", ""), "DefaultStyle")
            start = e.attrs.get("start", "1")
            return [el("OrderedList", [int(start) if re.fullmatch(r"-?\d{1,18}", start) else 1, el(style), el("DefaultDelim")], items)]
        if name == "dl":
            entries: list = []
            for k in e.kids:
                if isinstance(k, Element) and k.name == "dt":
                    entries.append([trim(self.inlines(k.kids)), []])
                elif isinstance(k, Element) and k.name == "dd" and entries:
                    entries[-1][1].append(self.blocks(k.kids, "Plain"))
            return [el("DefinitionList", entries)]
        if name == "pre":
            inner = next((k for k in e.kids if isinstance(k, Element) and k.name == "code"), None)
            a = attributes(e)
            if inner and not a[1]:
                a[1] = [c.removeprefix("language-") for c in inner.attrs.get("class", "").split()]
            return [el("CodeBlock", a, e.text().removeprefix("\n").removesuffix("\n"))]
        if name == "hr":
            return [el("HorizontalRule")]
        if name == "table":
            return self.table(e)
        if name == "figure":
            caption = next((k for k in e.kids if isinstance(k, Element) and k.name == "figcaption"), None)
            return [el("Figure", attributes(e), [None, self.blocks(caption.kids, "Plain") if caption else []], self.blocks([k for k in e.kids if k is not caption], "Plain"))]
        if name in ("div", "header", "section", "main"):
            a, inner = attributes(e), self.blocks(e.kids, "Plain")
            if a[0] and inner and inner[0]["t"] == "Header" and inner[0]["c"][1][0] == a[0]:
                inner[0]["c"][1][0] = ""  # the section has it
            return [el("Div", [a[0], ["section", *a[1]] if name == "section" else a[1], a[2]], inner)]
        return self.blocks(e.kids)

    def item(self, e: Element) -> list:
        if e.name != "li":
            return self.block(e) if e.name in BLOCKS else self.blocks([e], "Plain")
        inner = self.blocks(e.kids, "Plain")
        if "id" not in e.attrs:
            return inner
        # links aim at an item by its id, so what it holds carries it
        a = attr(e.attrs["id"])
        return [el("Plain", [el("Span", a, inner[0]["c"])])] if [b["t"] for b in inner] == ["Plain"] else [el("Div", a, inner)]

    def table(self, e: Element) -> list:
        sections: dict[str, list] = {"head": [], "body": [], "foot": []}
        caption: list = []

        def visit(node, section):
            nonlocal caption
            for k in node.kids:
                if not isinstance(k, Element):
                    continue
                if k.name == "caption":
                    caption = self.blocks(k.kids, "Plain")
                elif k.name in ("thead", "tbody", "tfoot"):
                    visit(k, k.name[1:])
                elif k.name == "tr":
                    cells = [c for c in k.kids if isinstance(c, Element) and c.name in ("td", "th")]
                    heads = cells and all(c.name == "th" for c in cells) and not sections["head"] and not sections["body"]
                    sections["head" if heads else section].append(cells)

        visit(e, "body")
        number = lambda c, k: int(v) if re.fullmatch(r"\d{1,4}", v := c.attrs.get(k, "1")) and int(v) else 1
        width = max((sum(number(c, "colspan") for c in r) for rows in sections.values() for r in rows), default=0)
        if not width:
            return []
        side = lambda c: {"left": "AlignLeft", "right": "AlignRight", "center": "AlignCenter"}.get((re.search(r"text-align:\s*(\w+)", c.attrs.get("style", "")) or [0, c.attrs.get("align", "")])[1], "AlignDefault")
        first = (sections["body"] or sections["head"] or [[]])[0]
        aligns = [a for c in first for a in [side(c)] * number(c, "colspan")]
        aligns = (aligns + ["AlignDefault"] * width)[:width]
        cell = lambda c: [attributes(c, ("colspan", "rowspan", "style", "align")), el("AlignDefault"), number(c, "rowspan"), number(c, "colspan"), self.blocks(c.kids, "Plain")]
        rows = {s: [[attr(), [cell(c) for c in r]] for r in rows] for s, rows in sections.items()}
        shares = [re.search(r"width:\s*([\d.]+)%", c.attrs.get("style", "")) or re.fullmatch(r"([\d.]+)%", c.attrs.get("width", "")) for c in e.find("col")]
        widths = [el("ColWidth", float(m[1]) / 100) if m else el("ColWidthDefault") for m in shares[:width]]
        widths += [el("ColWidthDefault")] * (width - len(widths))
        return [el("Table", attributes(e), [None, caption], [[el(a), w] for a, w in zip(aligns, widths)], [attr(), rows["head"]], [[attr(), 0, [], rows["body"]]], [attr(), rows["foot"]])]

    def unique(self, base: str) -> str:
        n = self.taken.get(base, 0)
        self.taken[base] = n + 1
        return f"{base}-{n}" if n else base


def identifier(text: str) -> str:
    """A heading's id: letters, digits, _ - . kept, lower case, words joined by -, up to the first letter dropped."""
    kept = "".join(c for c in text if c.isalnum() or c.isspace() or c in "_-.")
    joined = "-".join(kept.lower().split())
    return re.sub(r"^[\W\d_]+", "", joined) or "section"


def read_html(text: str, ids: bool = True) -> dict:
    """The document of a page: its main element if it has one, with title, language and named metadata."""
    try:
        root = tree(text)
        holders = [e for e in root.all() if e.attrs.get("role") == NOTES]
        notes = {e.attrs["id"]: e for h in holders for e in h.all() if e.attrs.get("id")}
        reader, meta = Reader(ids, notes), {}
        add = lambda k, v: meta.update({k: el("MetaList", [*meta[k]["c"], v]) if k in meta and meta[k]["t"] == "MetaList" else el("MetaList", [meta[k], v]) if k in meta else v})
        if root.attrs.get("lang"):
            add("lang", el("MetaInlines", [el("Str", root.attrs["lang"])]))
        title = next(root.find("title"), None)
        if title and title.text().strip():
            add("title", el("MetaInlines", trim(reader.tidy(words(title.text())))))
        for m in root.find("meta"):
            if m.attrs.get("name") and "content" in m.attrs:
                add(m.attrs["name"], el("MetaInlines", trim(words(m.attrs["content"]))))
        main = next((e for e in root.all() if e.name == "main" or e.attrs.get("role") == "main"), None)
        return document(reader.blocks(main.kids if main else root.kids, "Plain" if main else "Para"), meta)
    except RecursionError:
        raise DocumentError("nested too deeply") from None
