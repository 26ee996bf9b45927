"""Section numbers and contents of one tree; for tables of documents see relational."""

from __future__ import annotations

from docloom.ast import el
from docloom.operators.writers import Html, escape_html


def headings(blocks: list) -> list[dict]:
    """Headings at top level and inside of Divs, in order."""
    out = []
    for b in blocks:
        if b["t"] == "Header":
            out.append(b)
        elif b["t"] == "Div":
            out += headings(b["c"][1])
    return out


def number_sections(blocks: list) -> None:
    """Puts dotted numbers, counted from the least level, before headings; those of class unnumbered have and use none."""
    found = headings(blocks)
    if not found:
        return
    base, counts = min(h["c"][0] for h in found), [0] * 100
    for h in found:
        level, a, inner = h["c"]
        if "unnumbered" in a[1]:
            continue
        counts[level] += 1
        counts[level + 1 :] = [0] * (99 - level)
        number = ".".join(str(c) for c in counts[base : level + 1])
        a[2].append(["number", number])
        inner[:0] = [el("Span", ["", ["header-section-number"], []], [el("Str", number)]), el("Space")]


def contents_html(blocks: list, deepest: int = 3) -> str:
    """A nav of nested lists: an entry stands under the last earlier one of a lesser level."""
    writer = Html()
    roots: list = []
    stack: list = []  # (level, children)
    for h in headings(blocks):
        level, a, inner = h["c"]
        if level > deepest:
            continue
        while stack and stack[-1][0] >= level:
            stack.pop()
        text = writer.inlines([n for n in inner if n["t"] != "Note"])
        entry = (f'<a href="#{escape_html(a[0], True)}">{text}</a>' if a[0] else text, [])
        (stack[-1][1] if stack else roots).append(entry)
        stack.append((level, entry[1]))

    def listed(entries):
        return "<ul>\n" + "\n".join(f"<li>{text}{chr(10) + listed(kids) if kids else ''}</li>" for text, kids in entries) + "\n</ul>"

    return f'<nav id="TOC" role="doc-toc">\n{listed(roots)}\n</nav>' if roots else ""
