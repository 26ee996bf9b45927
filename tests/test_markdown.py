"""Markdown in and HTML out, by hand-written cases; and properties that hold for any text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.ast import DocumentError, dumps, walk
from docloom.operators.writers import WRITERS, write_text
from docloom.sources.markdown import read_markdown


def html(text, dialect="commonmark"):
    return write_text(read_markdown(text, dialect), "html").rstrip("\n")


CASES = [
    ("a *b* c", "<p>a <em>b</em> c</p>"),
    ("**a**b", "<p><strong>a</strong>b</p>"),
    ("***a***", "<p><em><strong>a</strong></em></p>"),
    ("*a **b***", "<p><em>a <strong>b</strong></em></p>"),
    ("a * b *", "<p>a * b *</p>"),
    ("snake_case_word", "<p>snake_case_word</p>"),
    ("`` a`b ``", "<p><code>a`b</code></p>"),
    ("a\\\nb", "<p>a<br />\nb</p>"),
    ("a  \nb", "<p>a<br />\nb</p>"),
    ("\\*a\\*", "<p>*a*</p>"),
    ("&copy; &#65; &nosuch;", "<p>© A &amp;nosuch;</p>"),
    ("[a](b 'c')", '<p><a href="b" title="c">a</a></p>'),
    ("[a](<b c>)", '<p><a href="b c">a</a></p>'),
    ("[a]\n\n[A]: /u", '<p><a href="/u">a</a></p>'),
    ("![a *b*](c)", '<p><img src="c" alt="a b" /></p>'),
    ("[a [b](c) d](e)", '<p>[a <a href="c">b</a> d](e)</p>'),
    ("<http://a.b>", '<p><a href="http://a.b">http://a.b</a></p>'),
    ("a <b c='d'> e", "<p>a <b c='d'> e</p>"),
    ("# a #", "<h1>a</h1>"),
    ("#a", "<p>#a</p>"),
    ("a\n=", "<h1>a</h1>"),
    ("a\n---", "<h2>a</h2>"),
    ("---", "<hr />"),
    ("* * *", "<hr />"),
    ("    a\n     b", "<pre><code>a\n b</code></pre>"),
    ("~~~ x\na\n~~~", '<pre class="x"><code>a</code></pre>'),
    ("> a\nb", "<blockquote>\n<p>a\nb</p>\n</blockquote>"),
    ("- a\n- b", "<ul>\n<li>a</li>\n<li>b</li>\n</ul>"),
    ("- a\n\n- b", "<ul>\n<li><p>a</p></li>\n<li><p>b</p></li>\n</ul>"),
    ("3) a\n4) b", '<ol start="3" type="1">\n<li>a</li>\n<li>b</li>\n</ol>'),
    ("- a\n  - b", "<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul></li>\n</ul>"),
    ("- a\n\n  b", "<ul>\n<li><p>a</p>\n<p>b</p></li>\n</ul>"),
    ("a\n- b", "<p>a</p>\n<ul>\n<li>b</li>\n</ul>"),
    ("a\n2. b", "<p>a\n2. b</p>"),
    ("<div>\n*a*\n</div>\n\nb", "<div>\n*a*\n</div>\n<p>b</p>"),
    ("1986\\. A", "<p>1986. A</p>"),
    ("", ""),
]


@pytest.mark.parametrize("text,want", CASES)
def test_commonmark(text, want):
    assert html(text) == want


GFM = [
    ("~~a~~ ~b~", "<p><del>a</del> <del>b</del></p>"),
    ("see www.a.bc/d.", '<p>see <a href="http://www.a.bc/d">www.a.bc/d</a>.</p>'),
    ("# A b\n\n# A b", '<h1 id="a-b">A b</h1>\n<h1 id="a-b-1">A b</h1>'),
    ("- [x] a\n- b", '<ul class="task-list">\n<li><label><input type="checkbox" checked="" />a</label></li>\n</ul>\n<ul>\n<li>b</li>\n</ul>'),
    ("$a_b$", '<p><span class="math inline">\\(a_b\\)</span></p>'),
    ("a[^1] b[^2]\n\n[^1]: c", "<p>a b[^2]</p>"),
]


@pytest.mark.parametrize("text,want", GFM)
def test_gfm(text, want):
    assert html(text, "gfm") == want


def test_footnote_bodies():
    notes = [n for n in walk(read_markdown("a[^x]\n\n[^x]: one\n    two", "gfm")["blocks"]) if n["t"] == "Note"]
    assert write_text({"blocks": notes[0]["c"]}, "plain") == "one two\n"


def test_front_matter_subset():
    doc = read_markdown("---\ntitle: A\nflag: true\nxs:\n- b\n---\n\nc", "markdown")
    assert list(doc["meta"]) == ["title", "flag", "xs"] and doc["meta"]["flag"] == {"t": "MetaBool", "c": True}
    with pytest.raises(DocumentError, match="line 2"):
        read_markdown("---\n? a\n---\n", "markdown")


def test_depth_is_bounded():
    with pytest.raises(DocumentError):
        read_markdown("> " * 300 + "a", "commonmark")


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["*a*", "**b**", "`c`", "[l](u)", "> q", "- i", "1. n", "# h", "```", "|a|b|", "|-|-|", "~~s~~", "x", "\n", "  ", "<b>", "\\", "&amp;", "![", "](", "_", "$m$", "[^1]", "    code"]), max_size=14).map(" ".join), st.sampled_from(["commonmark", "gfm", "markdown"]))
def test_any_text_is_read_and_written(text, dialect):
    doc = read_markdown(text.replace(" \n ", "\n"), dialect)
    dumps(doc)
    for to in WRITERS:
        assert isinstance(write_text(doc, to), str)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="abc*_`[]<>&\\#+-.1!~|$", min_size=1, max_size=6), min_size=1, max_size=6))
def test_written_markdown_reads_back(words):
    """Plain text of any signs, escaped by the writer, is the same text again."""
    blocks = [{"t": "Para", "c": [n for w in words for n in ({"t": "Str", "c": w}, {"t": "Space"})][:-1]}]
    for dialect in ("commonmark", "gfm"):
        text = write_text({"blocks": blocks}, dialect)
        assert write_text(read_markdown(text, dialect), "html") == write_text({"blocks": blocks}, "html"), text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "longer-word", "1.", "-", "+", "#", "x" * 30, "12)", "é"]), min_size=1, max_size=60), st.integers(5, 40))
def test_filled_lines(words, columns):
    words = ["start", *words]
    found = write_text(read_markdown(" ".join(words), "commonmark"), "commonmark", columns)
    lines, now = [], ""
    for w in words:
        if now and len(now) + 1 + len(w) > columns and w not in ("1.", "-", "+", "#", "12)"):
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}" if now else w
    assert found == "\n".join([*lines, now]) + "\n"


def test_filled_text_reads_back():
    text = "> " + "quoted words " * 12 + "\n\n- " + "an item of a list " * 9 + "\n  1. " + "inner words " * 9 + "\n\n# " + "head " * 20 + "\n"
    first = read_markdown(text, "gfm")
    again = read_markdown(write_text(first, "gfm", 30), "gfm")
    assert dumps(first) == dumps(again).replace("SoftBreak", "Space")
