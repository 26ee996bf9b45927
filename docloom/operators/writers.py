"""Text writers: HTML, markdown, plain text, LaTeX, reStructuredText and AsciiDoc."""

from __future__ import annotations

import re

from docloom.ast import cells_of, text_of

QUOTES = {"SingleQuote": ("‘", "’"), "DoubleQuote": ("“", "”")}
ALIGNS = {"AlignLeft": "left", "AlignRight": "right", "AlignCenter": "center"}


def escape_html(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("'", "&#39;") if attribute else text


def rows_of(table: list) -> tuple[list, list]:
    """Head rows and all other rows of a Table, as lists of cells' blocks."""
    head, rest = [], []
    for section, _, cells in cells_of(table):
        (head if section == "head" else rest).append([c[4] for c in cells])
    return head, rest


def is_task(item: list) -> str | None:
    """x or blank of an item that starts with a box."""
    first = item[0]["c"] if item and item[0]["t"] in ("Plain", "Para") else []
    if len(first) > 1 and first[0]["t"] == "Str" and first[0]["c"] in "☐☒" and first[0]["c"] and first[1]["t"] == "Space":
        return "x" if first[0]["c"] == "☒" else " "
    return None


def markers(attrs: list, n: int) -> list[str]:
    """Literal markers of an ordered list."""
    start, style, delim = attrs[0], attrs[1]["t"], attrs[2]["t"]
    shape = {"OneParen": "{})", "TwoParens": "({})"}.get(delim, "{}.")
    name = {"LowerAlpha": alpha, "UpperAlpha": lambda i: alpha(i).upper(), "LowerRoman": roman, "UpperRoman": lambda i: roman(i).upper()}.get(style, str)
    return [shape.format(name(start + i)) for i in range(n)]


def alpha(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += sign * (n // value)
        n %= value
    return out


class Writer:
    """Dispatches nodes to methods named by constructor in lower case; what has none writes its content."""

    def blocks(self, nodes: list) -> list[str]:
        return [s for n in nodes if (s := getattr(self, "b_" + n["t"].lower())(n.get("c"))) is not None]

    def inlines(self, nodes: list) -> str:
        """Words, blanks and soft line ends that follow each other are one text for i_str: no escape depends on where a word ends."""
        out, text, space, soft = [], [], self.i_space(None), self.i_softbreak(None)
        for n in nodes:
            t = n["t"]
            if t == "Str":
                text.append(n["c"])
            elif t == "Space":
                text.append(space)
            elif t == "SoftBreak":
                text.append(soft)
            else:
                if text:
                    out.append(self.i_str("".join(text)))
                    text = []
                out.append(getattr(self, "i_" + t.lower())(n.get("c")))
        if text:
            out.append(self.i_str("".join(text)))
        return "".join(out)

    def i_space(self, c):
        return " "

    def i_softbreak(self, c):
        return "\n"

    def i_linebreak(self, c):
        return "\n"

    def i_quoted(self, c):
        return QUOTES[c[0]["t"]][0] + self.inlines(c[1]) + QUOTES[c[0]["t"]][1]

    def i_span(self, c):
        return self.inlines(c[1])

    i_cite = i_span

    def wrapped(self, c):
        return self.inlines(c)

    i_underline = i_smallcaps = i_superscript = i_subscript = i_emph = i_strong = i_strikeout = wrapped

    def i_rawinline(self, c):
        return c[1] if c[0] in self.raw else ""

    def b_rawblock(self, c):
        return c[1] if c[0] in self.raw else None

    raw: tuple[str, ...] = ()


class Html(Writer):
    raw = ("html", "html4", "html5")

    def attributes(self, a: list, id_last: bool = False) -> str:
        ident = f' id="{escape_html(a[0], True)}"' if a[0] else ""
        rest = f' class="{escape_html(" ".join(a[1]), True)}"' if a[1] else ""
        for k, v in a[2]:
            name = k if k in ("width", "height", "lang", "dir", "title", "style", "role") or k.startswith(("data-", "aria-")) else "data-" + k
            rest += f' {name}="{escape_html(v, True)}"'
        return rest + ident if id_last else ident + rest

    def tag(self, name, inner, a="", sep=""):
        return f"<{name}{a}>{sep}{inner}{sep}</{name}>"

    def joined(self, nodes):
        return "\n".join(self.blocks(nodes))

    def b_plain(self, c):
        return self.inlines(c)

    def b_para(self, c):
        return self.tag("p", self.inlines(c))

    def b_lineblock(self, c):
        return self.tag("div", "<br />\n".join(map(self.inlines, c)), ' class="line-block"')

    def b_codeblock(self, c):
        return f"<pre{self.attributes(c[0])}><code>{escape_html(c[1], True)}</code></pre>"

    def b_blockquote(self, c):
        return self.tag("blockquote", self.joined(c), sep="\n")

    def items(self, items, boxes=False):
        out = []
        for item in items:
            inner = self.joined(item)
            if boxes:
                box = f'<label><input type="checkbox"{" checked=\"\"" if is_task(item) == "x" else ""} />'
                head, _, tail = inner.partition(" ")
                start = "<p>" if inner.startswith("<p>") else ""
                text, close, after = tail.partition("</p>") if start else (tail.partition("\n")[0], "", tail[len(tail.partition("\n")[0]) :])
                inner = f"{start}{box}{text}</label>{close}{after}"
            out.append(self.tag("li", inner))
        return "\n".join(out)

    def b_bulletlist(self, c):
        boxes = bool(c) and all(is_task(i) for i in c)
        return self.tag("ul", self.items(c, boxes), ' class="task-list"' * boxes, "\n")

    def b_orderedlist(self, c):
        kind = {"LowerAlpha": "a", "UpperAlpha": "A", "LowerRoman": "i", "UpperRoman": "I", "Decimal": "1"}.get(c[0][1]["t"])
        a = (f' start="{c[0][0]}"' if c[0][0] != 1 else "") + (f' type="{kind}"' if kind else "")
        return self.tag("ol", self.items(c[1]), a, "\n")

    def b_definitionlist(self, c):
        return self.tag("dl", "\n".join(x for term, bodies in c for x in [self.tag("dt", self.inlines(term)), *(self.tag("dd", self.joined(b), sep="\n") for b in bodies)]), sep="\n")

    def b_header(self, c):
        return self.tag(f"h{min(c[0], 6)}", self.inlines(c[2]), self.attributes(c[1], True))

    def b_horizontalrule(self, c):
        return "<hr />"

    def b_table(self, c):
        caption = self.tag("caption", self.joined(c[1][1])) if c[1][1] else ""
        aligns = [ALIGNS.get(s[0]["t"]) for s in c[2]]
        out = [caption] if caption else []
        sections: dict[str, list] = {}
        for section, _, cells in cells_of(c):
            name, row = "th" if section == "head" else "td", []
            for i, (_, own, rs, cs, inner) in enumerate(cells):
                side = ALIGNS.get(own["t"]) or (aligns[i] if i < len(aligns) else None)
                a = (f' colspan="{cs}"' if cs > 1 else "") + (f' rowspan="{rs}"' if rs > 1 else "") + (f' style="text-align: {side};"' if side else "")
                row.append(self.tag(name, self.joined(inner), a))
            sections.setdefault(section, []).append(self.tag("tr", "\n".join(row), sep="\n"))
        out += [self.tag("t" + s, "\n".join(sections[s]), sep="\n") for s in ("head", "body", "foot") if s in sections]
        return self.tag("table", "\n".join(out), self.attributes(c[0]), "\n")

    def b_figure(self, c):
        return self.tag("figure", "\n".join([self.joined(c[2]), *([self.tag("figcaption", self.joined(c[1][1]))] if c[1][1] else [])]), self.attributes(c[0]), "\n")

    def b_div(self, c):
        return self.tag("div", self.joined(c[1]), self.attributes(c[0]), "\n")

    def i_str(self, c):
        return escape_html(c)

    def i_linebreak(self, c):
        return "<br />\n"

    def i_emph(self, c):
        return self.tag("em", self.inlines(c))

    def i_strong(self, c):
        return self.tag("strong", self.inlines(c))

    def i_underline(self, c):
        return self.tag("u", self.inlines(c))

    def i_strikeout(self, c):
        return self.tag("del", self.inlines(c))

    def i_superscript(self, c):
        return self.tag("sup", self.inlines(c))

    def i_subscript(self, c):
        return self.tag("sub", self.inlines(c))

    def i_smallcaps(self, c):
        return self.tag("span", self.inlines(c), ' class="smallcaps"')

    def i_code(self, c):
        return self.tag("code", escape_html(c[1]), self.attributes(c[0]))

    def i_math(self, c):
        kind, (a, b) = ("display", ("\\[", "\\]")) if c[0]["t"] == "DisplayMath" else ("inline", ("\\(", "\\)"))
        return f'<span class="math {kind}">{a}{escape_html(c[1])}{b}</span>'

    def i_link(self, c):
        title = f' title="{escape_html(c[2][1], True)}"' if c[2][1] else ""
        return f'<a href="{escape_html(c[2][0], True)}"{title}{self.attributes(c[0])}>{self.inlines(c[1])}</a>'

    def i_image(self, c):
        title = f' title="{escape_html(c[2][1], True)}"' if c[2][1] else ""
        return f'<img src="{escape_html(c[2][0], True)}"{title} alt="{escape_html(text_of(c[1]), True)}"{self.attributes(c[0])} />'

    def i_note(self, c):
        return ""

    def i_span(self, c):
        return self.tag("span", self.inlines(c[1]), self.attributes(c[0]))


class Text(Writer):
    """Plain text; blocks apart by a blank line, notes at the end."""

    def __init__(self):
        self.notes: list[str] = []

    def joined(self, nodes, tight=False):
        return ("\n" if tight else "\n\n").join(self.blocks(nodes))

    def indented(self, text, by, first=None):
        pad = " " * by
        lines = text.split("\n")
        return "\n".join([(first if first is not None else pad) + lines[0], *(pad + x if x else x for x in lines[1:])])

    def whole(self, nodes):
        return "\n\n".join([x for x in [self.joined(nodes), *self.ends()] if x])

    def ends(self):
        return self.notes

    def b_plain(self, c):
        return self.inlines(c)

    b_para = b_plain

    def b_lineblock(self, c):
        return "\n".join(map(self.inlines, c))

    def b_codeblock(self, c):
        return self.indented(c[1], 4)

    def b_blockquote(self, c):
        return self.indented(self.joined(c), 2)

    def listed(self, items, marks, width=None):
        out, loose = [], any(b["t"] == "Para" for i in items for b in i)
        for mark, item in zip(marks, items):
            w = max(width or 0, len(mark) + 1)
            out.append(self.indented(self.joined(item, not loose), w, mark.ljust(w)) if item else mark)
        return ("\n\n" if loose else "\n").join(out)

    def b_bulletlist(self, c):
        return self.listed(c, ["-"] * len(c))

    def b_orderedlist(self, c):
        return self.listed(c[1], markers(c[0], len(c[1])), 4)

    def b_definitionlist(self, c):
        return "\n\n".join("\n".join([self.inlines(term), *(self.indented(self.joined(b), 4) for b in bodies)]) for term, bodies in c)

    def b_header(self, c):
        return self.inlines(c[2])

    def b_horizontalrule(self, c):
        return "-" * 72

    def b_table(self, c):
        head, rest = rows_of(c)
        grid = [[self.joined(cell).replace("\n", " ") for cell in row] for row in [*head, *rest]]
        if not grid:
            return ""
        widths = [max([len(r[i]) for r in grid if i < len(r)], default=0) for i in range(max(map(len, grid)))]
        lines = [" ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in grid]
        lines.insert(len(head), " ".join("-" * max(1, w) for w in widths))
        return "\n".join(["\n".join(lines), *([""] + [self.joined(c[1][1])] if c[1][1] else [])])

    def b_figure(self, c):
        return self.joined([*c[2], *c[1][1]])

    def b_div(self, c):
        return self.joined(c[1])

    def i_str(self, c):
        return c

    def i_softbreak(self, c):
        return " "

    def i_quoted(self, c):
        return self.inlines(c[1])

    def i_strikeout(self, c):
        return f"~~{self.inlines(c)}~~"

    def i_code(self, c):
        return c[1]

    i_math = i_code

    def i_link(self, c):
        return self.inlines(c[1])

    def i_image(self, c):
        return f"[{self.inlines(c[1])}]"

    def i_note(self, c):
        self.notes.append("")
        n = len(self.notes)
        self.notes[n - 1] = f"[{n}] {self.joined(c)}"
        return f"[{n}]"


_BREAK = "\x1f"  # where a line may end
_LEAD = re.compile(r"(?:> ?| |[-*+] +(?=\S)|\d{1,9}[.)] +)*")
_MARK = re.compile(r"[-+*>=#|]|\d{1,9}[.)]$|~~~|```")


def filled(line: str, columns: int) -> str:
    """A line with breaks as lines of up to `columns` characters, greedily; what quotes or sets it in is repeated. A word
    that would start a block never starts a line; tables and headings stay one line."""
    if _BREAK not in line:
        return line
    lead = _LEAD.match(line)[0]
    rest = line[len(lead) :]
    if rest.startswith(("|", "#")):
        return line.replace(_BREAK, " ")
    inset = re.sub(r"[^>]", " ", lead)
    out, now = [], ""
    for word in rest.split(_BREAK):
        if now and len(lead if not out else inset) + len(now) + 1 + len(word) > columns and not _MARK.match(word):
            out.append((inset if out else lead) + now)
            now = word
        else:
            now = f"{now} {word}" if now else word
    return "\n".join([*out, (inset if out else lead) + now])


class Markdown(Text):
    raw = ("html",)

    def __init__(self, gfm: bool = True, columns: int | None = None):
        """columns: lines of paragraphs are filled up to it, soft line ends being blanks; else they stay as they are."""
        super().__init__()
        self.gfm, self.columns = gfm, columns

    def i_space(self, c):
        return _BREAK if self.columns else " "

    def whole(self, nodes):
        text = super().whole(nodes)
        return "\n".join(filled(line, self.columns) for line in text.split("\n")) if self.columns else text

    def blocks(self, nodes):
        """Neighbouring lists of one kind are kept apart: bullets alternate, numbers get a comment between them."""
        out, before, dash = [], None, "-"
        for n in nodes:
            kind = n["t"]
            if kind == "BulletList":
                dash = ("*" if dash == "-" else "-") if before == kind else "-"
                out.append(self.listed(n["c"], [dash] * len(n["c"])))
            else:
                if kind == before == "OrderedList":
                    out.append("<!-- -->")
                if (s := getattr(self, "b_" + kind.lower())(n.get("c"))) is not None:
                    out.append(s)
            before = kind
        return out

    def b_plain(self, c):
        return self.line_safe(self.inlines(c))

    b_para = b_plain

    def line_safe(self, text):
        """Escapes what would start a block at the start of a line."""
        text = re.sub(r"(?m)^(\s*)([-+](?=\s|$)|#{1,6}(?=\s|$)|>|=+\s*$)", r"\1\\\2", text)
        text = re.sub(r"(?m)^(\s*)(-{2,}\s*)$", r"\1\\\2", text)
        return re.sub(r"(?m)^(\s*\d{1,9})([.)])(?=\s|$)", r"\1\\\2", text)

    def listed(self, items, marks, width=None):
        if self.gfm:
            boxed = [is_task(i) for i in items]
            items = [[{**i[0], "c": [{"t": "RawInline", "c": ["html", f"[{b}]"]}, *i[0]["c"][1:]]}, *i[1:]] if b else i for i, b in zip(items, boxed)]
        return super().listed(items, marks, None)

    def b_lineblock(self, c):
        return "  \n".join(map(self.inlines, c))

    def b_codeblock(self, c):
        runs = [len(r) for r in re.findall("`+", c[1])]
        fence = "`" * (max([2, *runs]) + 1)
        info = next((k for k in c[0][1] if k != "sourceCode"), "")
        return f"{fence}{' ' + info if info else ''}\n{c[1]}\n{fence}" if c[1] else f"{fence}{' ' + info if info else ''}\n{fence}"

    def b_blockquote(self, c):
        return "\n".join("> " + x if x else ">" for x in self.joined(c).split("\n"))

    def b_orderedlist(self, c):
        close = ")" if c[0][2]["t"] == "OneParen" else "."
        return self.listed(c[1], [f"{c[0][0] + i}{close}" for i in range(len(c[1]))])

    def b_definitionlist(self, c):
        return "\n\n".join(x for term, bodies in c for x in [self.inlines(term), *(self.joined(b) for b in bodies)])

    def b_header(self, c):
        text = self.inlines(c[2])
        if "\n" in text and c[0] < 3:
            return text + "\n" + ("=" if c[0] == 1 else "-") * max(3, max(map(len, text.split("\n"))))
        return ("#" * min(c[0], 6) + " " + re.sub(r"(#+)$", r"\\\1", text.replace("\n", " "))).rstrip()

    def b_horizontalrule(self, c):
        return "***"

    def b_table(self, c):
        head, rest = rows_of(c)
        cell = lambda x: self.joined(x).replace("\n", " ").replace("|", "\\|")
        if not self.gfm:
            return "\n\n".join(cell(x) for r in [*head, *rest] for x in r)
        n = len(c[2])
        line = lambda xs: "| " + " | ".join((xs + [""] * n)[:n]) + " |"
        marks = {"AlignLeft": ":---", "AlignRight": "---:", "AlignCenter": ":---:"}
        top = [[cell(x) for x in r] for r in head] or [[""] * n]
        lines = [line(top[0]), line([marks.get(s[0]["t"], "---") for s in c[2]]), *map(line, top[1:]), *(line([cell(x) for x in r]) for r in rest)]
        return "\n".join(lines) + ("\n\n" + self.joined(c[1][1]) if c[1][1] else "")

    def i_str(self, c):
        c = re.sub(r"([\\`*_\[\]<])", r"\\\1", c)
        c = re.sub(r"&(?=#?\w+;)", r"\\&", c)
        return re.sub(r"([~$])", r"\\\1", c) if self.gfm else c

    def i_softbreak(self, c):
        return _BREAK if self.columns else "\n"

    def i_linebreak(self, c):
        return "  \n"

    def i_quoted(self, c):
        return Writer.i_quoted(self, c)

    def i_emph(self, c):
        mark = "_" if len(c) == 1 and c[0]["t"] in ("Emph", "Strong") else "*"
        return f"{mark}{self.inlines(c)}{mark}"

    def i_strong(self, c):
        return f"**{self.inlines(c)}**"

    def i_strikeout(self, c):
        return f"~~{self.inlines(c)}~~" if self.gfm else f"<s>{self.inlines(c)}</s>"

    def i_underline(self, c):
        return f"<u>{self.inlines(c)}</u>"

    def i_superscript(self, c):
        return f"<sup>{self.inlines(c)}</sup>"

    def i_subscript(self, c):
        return f"<sub>{self.inlines(c)}</sub>"

    def i_code(self, c):
        tick = "`" * (max([0, *(len(r) for r in re.findall("`+", c[1]))]) + 1)
        pad = " " if c[1][:1] in ("`", " ") or c[1][-1:] in ("`", " ") else ""
        return f"{tick}{pad}{c[1]}{pad}{tick}"

    def i_math(self, c):
        mark = "$$" if c[0]["t"] == "DisplayMath" else "$"
        return f"{mark}{c[1]}{mark}"

    def target(self, c):
        url = f"<{c[2][0]}>" if re.search(r"[\s()]", c[2][0]) or not c[2][0] else c[2][0]
        return f"({url} \"{c[2][1].replace('\"', '\\\"')}\")" if c[2][1] else f"({url})"

    def i_link(self, c):
        text = text_of(c[1])
        if text == c[2][0] and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*$", text) and not c[2][1]:
            return f"<{text}>"
        return f"[{self.inlines(c[1])}]{self.target(c)}"

    def i_image(self, c):
        return f"![{self.inlines(c[1])}]{self.target(c)}"

    def i_note(self, c):
        self.notes.append("")
        n = len(self.notes)
        self.notes[n - 1] = self.indented(self.joined(c), 4, f"[^{n}]: ")
        return f"[^{n}]"


class Latex(Text):
    raw = ("latex", "tex")
    names = ("section", "subsection", "subsubsection", "paragraph", "subparagraph")

    def ends(self):
        return []

    def env(self, name, inner, after=""):
        return f"\\begin{{{name}}}{after}\n{inner}\n\\end{{{name}}}"

    def b_lineblock(self, c):
        return "\\\\\n".join(map(self.inlines, c))

    def b_codeblock(self, c):
        return self.env("verbatim", c[1].rstrip())

    def b_blockquote(self, c):
        return self.env("quote", self.joined(c))

    def items(self, items):
        tight = not any(b["t"] == "Para" for i in items for b in i)
        return "\\tightlist\n" * tight + "\n".join("\\item\n" + self.indented(self.joined(i), 2) for i in items)

    def b_bulletlist(self, c):
        return self.env("itemize", self.items(c))

    def b_orderedlist(self, c):
        start = f"\\setcounter{{enumi}}{{{c[0][0] - 1}}}\n" if c[0][0] != 1 else ""
        style = {"LowerAlpha": "alph", "UpperAlpha": "Alph", "LowerRoman": "roman", "UpperRoman": "Roman"}.get(c[0][1]["t"], "arabic")
        close = ")" if c[0][2]["t"] == "OneParen" else "."
        return self.env("enumerate", f"{start}\\def\\labelenumi{{\\{style}{{enumi}}{close}}}\n" + self.items(c[1]))

    def b_definitionlist(self, c):
        return self.env("description", "\n".join(f"\\item[{self.inlines(t)}]\n" + "\n\n".join(self.joined(b) for b in bodies) for t, bodies in c))

    def b_header(self, c):
        text = self.inlines(c[2])
        if c[0] > len(self.names):
            return text
        return f"\\{self.names[c[0] - 1]}{{{text}}}" + (f"\\label{{{c[1][0]}}}" if c[1][0] else "")

    def b_horizontalrule(self, c):
        return "\\begin{center}\\rule{0.5\\linewidth}{0.5pt}\\end{center}"

    def b_table(self, c):
        head, rest = rows_of(c)
        line = lambda r: " & ".join(self.joined(x).replace("\n", " ") for x in r) + " \\\\"
        inner = ["\\toprule", *map(line, head), "\\midrule", "\\endhead", *map(line, rest), "\\bottomrule"]
        if c[1][1]:
            inner.insert(0, f"\\caption{{{self.joined(c[1][1])}}}\\tabularnewline")
        return self.env("longtable", "\n".join(inner), f"[]{{@{{}}{'l' * len(c[2])}@{{}}}}")

    def b_figure(self, c):
        return self.env("figure", "\\centering\n" + self.joined(c[2]) + (f"\n\\caption{{{self.joined(c[1][1])}}}" if c[1][1] else ""))

    def i_str(self, c):
        c = re.sub(r"[\\~^]", lambda m: {"\\": "\0b", "~": "\0t", "^": "\0c"}[m[0]], c)
        c = re.sub(r"([#$%&_{}])", r"\\\1", c)
        return c.replace("\0b", "\\textbackslash{}").replace("\0t", "\\textasciitilde{}").replace("\0c", "\\textasciicircum{}")

    def i_linebreak(self, c):
        return "\\\\\n"

    def named(name):  # noqa: N805
        return lambda self, c: f"\\{name}{{{self.inlines(c)}}}"

    i_emph, i_strong, i_underline, i_strikeout = named("emph"), named("textbf"), named("underline"), named("sout")
    i_superscript, i_subscript, i_smallcaps = named("textsuperscript"), named("textsubscript"), named("textsc")

    def i_quoted(self, c):
        a, b = ("``", "''") if c[0]["t"] == "DoubleQuote" else ("`", "'")
        return a + self.inlines(c[1]) + b

    def i_code(self, c):
        free = next((d for d in "|!@=+/" if d not in c[1]), None)
        return f"\\verb{free}{c[1]}{free}" if free and "\n" not in c[1] else f"\\texttt{{{self.i_str(c[1])}}}"

    def i_math(self, c):
        return f"\\[{c[1]}\\]" if c[0]["t"] == "DisplayMath" else f"\\({c[1]}\\)"

    def i_link(self, c):
        return f"\\href{{{re.sub(r'([#%&])', r'\\\1', c[2][0])}}}{{{self.inlines(c[1])}}}"

    def i_image(self, c):
        return f"\\includegraphics[alt={{{self.inlines(c[1])}}}]{{{c[2][0]}}}"

    def i_note(self, c):
        return f"\\footnote{{{self.joined(c)}}}"


class Rst(Text):
    raw = ("rst",)
    lines = "=-~^\"'"

    def __init__(self):
        super().__init__()
        self.images: list[str] = []

    def ends(self):
        return [*self.images, *self.notes]

    def b_para(self, c):
        if len(c) == 1 and c[0]["t"] == "Image":
            return f".. image:: {c[0]['c'][2][0]}" + (f"\n   :alt: {alt}" if (alt := text_of(c[0]["c"][1])) else "")
        return self.inlines(c)

    def b_lineblock(self, c):
        return "\n".join("| " + self.inlines(x) for x in c)

    def b_codeblock(self, c):
        return (f".. code-block:: {c[0][1][0]}" if c[0][1] else "::") + "\n\n" + self.indented(c[1], 3)

    def b_blockquote(self, c):
        return self.indented(self.joined(c), 3)

    def b_definitionlist(self, c):
        return "\n\n".join(self.inlines(t) + "\n" + self.indented("\n\n".join(self.joined(b) for b in bodies), 3) for t, bodies in c)

    def b_header(self, c):
        text = self.inlines(c[2]).replace("\n", " ")
        anchor = f".. _{c[1][0]}:\n\n" if c[1][0] else ""
        return f"{anchor}{text}\n{self.lines[min(c[0], 6) - 1] * max(1, len(text))}"

    def b_orderedlist(self, c):
        return self.listed(c[1], markers(c[0], len(c[1])))

    def b_horizontalrule(self, c):
        return "----"

    def b_table(self, c):
        head, rest = rows_of(c)
        grid = [[self.joined(x).split("\n") for x in r] for r in [*head, *rest]]
        n = max(map(len, grid), default=0)
        widths = [max([len(y) for r in grid if i < len(r) for y in r[i]], default=0) for i in range(n)]
        rule = lambda ch: "+" + "+".join(ch * (w + 2) for w in widths) + "+"
        out = [rule("-")]
        for at, r in enumerate(grid):
            for k in range(max(map(len, r), default=1)):
                out.append("|" + "|".join(f" {(r[i][k] if i < len(r) and k < len(r[i]) else '').ljust(w)} " for i, w in enumerate(widths)) + "|")
            out.append(rule("=" if at == len(head) - 1 else "-"))
        return "\n".join(out)

    def i_str(self, c):
        return re.sub(r"([*`|\\])", r"\\\1", c)

    i_softbreak = Writer.i_softbreak
    i_quoted = Writer.i_quoted

    def i_emph(self, c):
        return f"*{self.inlines(c)}*"

    def i_strong(self, c):
        return f"**{self.inlines(c)}**"

    def i_strikeout(self, c):
        return self.inlines(c)

    def i_superscript(self, c):
        return f":sup:`{self.inlines(c)}`"

    def i_subscript(self, c):
        return f":sub:`{self.inlines(c)}`"

    def i_code(self, c):
        return f"``{c[1]}``"

    def i_math(self, c):
        return f":math:`{c[1]}`"

    def i_link(self, c):
        return f"`{self.inlines(c[1])} <{c[2][0]}>`__"

    def i_image(self, c):
        name = text_of(c[1]) or f"image{len(self.images) + 1}"
        self.images.append(f".. |{name}| image:: {c[2][0]}")
        return f"|{name}|"

    def i_note(self, c):
        self.notes.append("")
        n = len(self.notes)
        self.notes[n - 1] = self.indented(self.joined(c), 3, ".. [#] ")
        return " [#]_"


class Asciidoc(Text):
    raw = ("asciidoc",)

    def __init__(self):
        super().__init__()
        self.level = 0

    def ends(self):
        return []

    def fenced(self, text, ch, head):
        longest = max([len(m) for m in re.findall(rf"(?m)^{re.escape(ch)}+$", text)], default=0)
        fence = ch * max(4, longest + 1)
        return f"{head}\n{fence}\n{text}\n{fence}"

    def b_lineblock(self, c):
        return "[verse]\n--\n" + "\n".join(map(self.inlines, c)) + "\n--"

    def b_codeblock(self, c):
        return self.fenced(c[1], "-", f"[source,{c[0][1][0]}]" if c[0][1] else "[source]") if c[0][1] else self.fenced(c[1], ".", "").lstrip("\n")

    def b_blockquote(self, c):
        return self.fenced(self.joined(c), "_", "[quote]")

    def nested(self, items, ch):
        self.level += 1
        out = []
        for item in items:
            parts = self.blocks(item)
            text = f"{ch * self.level} {parts[0] if parts else ''}"
            for block, part in zip(item[1:], parts[1:]):
                text += ("\n" if block["t"] in ("BulletList", "OrderedList") else "\n+\n") + part
            out.append(text)
        self.level -= 1
        return "\n".join(out)

    def b_bulletlist(self, c):
        return self.nested(c, "*")

    def b_orderedlist(self, c):
        style = {"LowerAlpha": "loweralpha", "UpperAlpha": "upperalpha", "LowerRoman": "lowerroman", "UpperRoman": "upperroman"}.get(c[0][1]["t"])
        return (f"[{style}]\n" if style else "") + (f"[start={c[0][0]}]\n" if c[0][0] != 1 else "") + self.nested(c[1], ".")

    def b_definitionlist(self, c):
        return "\n".join(f"{self.inlines(t)}::\n" + "\n".join(self.indented(self.joined(b), 2) for b in bodies) for t, bodies in c)

    def b_header(self, c):
        return (f"[[{c[1][0]}]]\n" if c[1][0] else "") + "=" * (min(c[0], 5) + 1) + " " + self.inlines(c[2])

    def b_horizontalrule(self, c):
        return "'''"

    def b_table(self, c):
        head, rest = rows_of(c)
        line = lambda r: " ".join("|" + self.joined(x).replace("|", "\\|") for x in r)
        title = f".{self.joined(c[1][1])}\n" if c[1][1] else ""
        top = f'[cols="{",".join("1" for _ in c[2])}"' + (',options="header"' if head else "") + "]"
        return f"{title}{top}\n|===\n" + "\n".join(map(line, [*head, *rest])) + "\n|==="

    def b_figure(self, c):
        return (f".{self.joined(c[1][1])}\n" if c[1][1] else "") + self.joined(c[2])

    def i_str(self, c):
        return re.sub(r"([*_#^~\\`])", r"\\\1", c)

    i_softbreak = Writer.i_softbreak
    i_quoted = Writer.i_quoted

    def i_linebreak(self, c):
        return " +\n"

    def around(a, b=None):  # noqa: N805
        return lambda self, c: f"{a}{self.inlines(c)}{b or a}"

    i_emph, i_strong, i_superscript, i_subscript = around("_"), around("*"), around("^"), around("~")
    i_underline, i_strikeout, i_smallcaps = around("[.underline]#", "#"), around("[.line-through]#", "#"), around("[.smallcaps]#", "#")

    def i_code(self, c):
        return f"`{c[1]}`"

    def i_math(self, c):
        return f"latexmath:[{c[1]}]"

    def i_link(self, c):
        return f"<<{c[2][0][1:]},{self.inlines(c[1])}>>" if c[2][0].startswith("#") else f"{c[2][0]}[{self.inlines(c[1])}]"

    def i_image(self, c):
        return f"image:{c[2][0]}[{text_of(c[1])}]"

    def i_note(self, c):
        return f"footnote:[{self.joined(c)}]"


WRITERS = {"html": Html, "gfm": Markdown, "commonmark": lambda: Markdown(False), "plain": Text, "latex": Latex, "rst": Rst, "asciidoc": Asciidoc}


def write_text(doc: dict, to: str, columns: int | None = None) -> str:
    """The text of a document in one of WRITERS' formats, with a line end unless it is empty. columns fills the
    paragraphs of markdown; the other formats keep their lines."""
    writer = Markdown(to == "gfm", columns) if columns and to in ("gfm", "commonmark") else WRITERS[to]()
    text = writer.joined(doc["blocks"]) if isinstance(writer, Html) else writer.whole(doc["blocks"])
    return text + "\n" if text else ""


def html_page(doc: dict, css: str | None = None, toc: str = "") -> str:
    """A whole page around the HTML fragment: language, authors, title, style and contents."""
    meta = {k: meta_texts(v) for k, v in doc["meta"].items()}
    title = (meta.get("title") or [""])[0]
    head = ["<meta charset=\"utf-8\" />", *(f'<meta name="author" content="{escape_html(a, True)}" />' for a in meta.get("author", [])), f"<title>{escape_html(title)}</title>"]
    if css:
        head.append(f"<style>\n{re.sub('(?i)</style', '<\\\\/style', css)}\n</style>")
    lang = (meta.get("lang") or [""])[0]
    body = "".join(x + "\n" for x in (f'<h1 class="title">{escape_html(title)}</h1>' if title else "", toc) if x)
    return f"<!DOCTYPE html>\n<html{f' lang=\"{escape_html(lang, True)}\"' if lang else ''}>\n<head>\n" + "\n".join(head) + f"\n</head>\n<body>\n{body}{write_text(doc, 'html')}</body>\n</html>\n"


def meta_texts(value: dict) -> list[str]:
    """Texts of a metadata value; a list's items each for itself."""
    t, c = value["t"], value.get("c")
    if t == "MetaList":
        return [x for v in c for x in meta_texts(v)]
    if t == "MetaMap":
        return [x for v in c.values() for x in meta_texts(v)]
    return [str(c).lower() if t == "MetaBool" else c if t == "MetaString" else text_of(c)]
