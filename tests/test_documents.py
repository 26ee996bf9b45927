"""Document tables: readers, writers, nodes, relational operators and queries."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from docloom import ast, queries
from docloom.ast import walk
from docloom.functions import text as fn
from docloom.operators import relational as rel
from docloom.operators.writers import html_page, write_text
from docloom.plans import documents as doc
from docloom.sources import packages
from docloom.sources.html import identifier, read_html
from docloom.sources.markdown import read_markdown

SAMPLE = """# Title *one*

Para with **bold _nested_ text**, `code`, [link](http://x.y) and note[^1].

> quote

1. one
2. two

- a
  - b

| a | b |
|---|---|
| 1 | 2 |

```
code
```

***

[^1]: The note.
"""


def gfm(text):
    return read_markdown(text, "gfm")


@pytest.mark.parametrize("fmt", ["docx", "odt"])
def test_office_round_trip(fmt):
    read, write = doc.PACKAGES[fmt]
    once = read(write(gfm(SAMPLE), {}))[0]
    assert [b["t"] for b in once["blocks"]] == [b["t"] for b in gfm(SAMPLE)["blocks"]]
    assert write_text(once, "plain").replace("\n\n", "\n") == write_text(gfm(SAMPLE), "plain").replace("\n\n", "\n")
    assert read(write(once, {}))[0] == once
    assert write(once, {}) == write(once, {})


@pytest.mark.parametrize("fmt", ["docx", "odt"])
def test_images_travel(fmt):
    read, write = doc.PACKAGES[fmt]
    found, media = read(write(gfm("![alt](pic.png)"), {"pic.png": b"\x89PNG..."}))
    assert list(media.values()) == [b"\x89PNG..."]
    image = next(n for n in walk(found["blocks"]) if n["t"] == "Image")
    assert image["c"][2][0] in media
    assert "alt" in write_text(read(write(gfm("![alt](missing.png)"), {}))[0], "plain")


def test_self_referring_note_ends():
    data = packages.write_docx(gfm("a[^1]\n\n[^1]: b"))
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(data))
    parts = [(n, z.read(n)) for n in z.namelist()]
    loop = [(n, d.replace(b"<w:t xml:space=\"preserve\">b</w:t></w:r>", b"<w:t>b</w:t></w:r><w:r><w:footnoteReference w:id=\"2\"/></w:r>") if n.endswith("footnotes.xml") else d) for n, d in parts]
    assert write_text(packages.read_docx(packages.zipped(loop))[0], "plain") == "a[1]\n\n[1] b\n"


def test_docx_definition_list_round_trip():
    para = lambda x: ast.el("Para", [ast.el("Str", x)])
    made = ast.el("DefinitionList", [[[ast.el("Str", "a")], [[para("one")], [para("two")]]], [[ast.el("Str", "b")], [[para("three")]]]])
    tree = {"pandoc-api-version": [1, 23, 1], "meta": {}, "blocks": [made, para("after")]}
    assert packages.read_docx(packages.write_docx(tree))[0]["blocks"] == [made, para("after")]
    alone = packages.zipped([("word/document.xml", f'<w:document {packages._NS}><w:body><w:p><w:pPr><w:pStyle w:val="Definition"/></w:pPr><w:r><w:t>x</w:t></w:r></w:p></w:body></w:document>')])
    assert packages.read_docx(alone)[0]["blocks"] == [para("x")]


def test_merged_cells_of_a_docx_table():
    cell = lambda text, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    rows = [cell("a", '<w:vMerge w:val="restart"/>') + cell("b", '<w:gridSpan w:val="2"/>'), cell("", "<w:vMerge/>") + cell("c") + cell("d")]
    body = "<w:tbl>" + "".join(f"<w:tr>{r}</w:tr>" for r in rows) + "</w:tbl>"
    found, _ = packages.read_docx(packages.zipped([("word/document.xml", f"<w:document {packages._NS}><w:body>{body}</w:body></w:document>")]))
    table = found["blocks"][0]["c"]
    assert [[(c[2], c[3]) for c in row[1]] for row in table[4][0][3]] == [[(2, 1), (1, 2)], [(1, 1), (1, 1)]]


def test_epub_chapters_in_spine_order():
    data = packages.write_epub(gfm("# One\n\na\n\n# Two\n\nb"))
    found, _ = packages.read_epub(data)
    assert [b["c"][1][0] for b in found["blocks"] if b["t"] == "Header"] == ["ch001.xhtml_one", "ch002.xhtml_two"]
    assert data[30:38] == b"mimetype" and packages.write_epub(gfm("# One")) == packages.write_epub(gfm("# One"))


def test_notebook_outputs():
    book = {"nbformat": 4, "cells": [
        {"cell_type": "markdown", "id": "m", "source": ["# A\n", "b"]},
        {"cell_type": "code", "id": "c", "execution_count": 3, "source": "1+1", "outputs": [
            {"output_type": "stream", "name": "stdout", "text": ["x\n"]}, {"output_type": "error", "ename": "E", "evalue": "v", "traceback": ["\x1b[31mboom\x1b[0m"]},
            {"output_type": "display_data", "data": {"text/plain": "p", "image/png": "iVBORw=="}}]}]}
    found, media = packages.read_notebook(json.dumps(book).encode())
    text = write_text(found, "plain")
    assert "boom" in text and "\x1b" not in text and len(media) == 1
    again, _ = packages.read_notebook(packages.write_notebook(found))
    assert [b["c"][0][:2] for b in again["blocks"]] == [b["c"][0][:2] for b in found["blocks"]]


def test_html_repairs():
    cases = {
        "<p>a<p>b": "<p>a</p>\n<p>b</p>",
        "<b> x </b>y": "<p><strong>x</strong> y</p>",
        "<ul><li>a<li>b</ul>": "<ul>\n<li>a</li>\n<li>b</li>\n</ul>",
        "<main><p>in</main><p>out": "<p>in</p>",
        "<script>var p='</p>'</script>a": "<p>a</p>",
        "<table><tr><th>h<tr><td>1</table>": "<table>\n<thead>\n<tr>\n<th>h</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n</tr>\n</tbody>\n</table>",
        "a<br> b": "<p>a<br />\nb</p>",
    }
    for text, want in cases.items():
        assert write_text(read_html(text), "html").rstrip("\n") == want, text
    assert read_html("<h1>A b</h1><h1>A b</h1>")["blocks"][1]["c"][1][0] == "a-b-1"
    assert identifier("12. Hello World!") == "hello-world" and identifier("***") == "section"


def test_page_guards_its_style():
    page = html_page(read_markdown("---\ntitle: T\nlang: en\n---\n\na", "markdown"), "p{}</style><script>")
    assert "</style><script>" not in page and '<html lang="en">' in page and "<title>T</title>" in page


def test_bad_rows_become_errors(spark):
    rows = [(1, "docx", b"not a zip"), (2, "json", b"{"), (3, "markdown", b"---\n? x\n---\n"), (4, "gfm", b"fine"), (5, "nosuch", b"x"), (6, "gfm", None), (7, "commonmark", b"> " * 300 + b"a"), (8, "epub", b""), (9, "ipynb", b"[]")]
    found = {r.doc_id: r for r in doc.parse(spark.createDataFrame(rows, "doc_id long, format string, content binary")).collect()}
    assert all(found[i].error and found[i].ast_json is None for i in (1, 2, 3, 5, 7, 8, 9))
    assert found[4].ast_json and not found[4].error and found[6].ast_json is None and found[6].error is None


def test_mutated_packages_never_fail_a_job(spark):
    rng = random.Random(4)
    rows = []
    for fmt in ("docx", "odt", "epub", "ipynb", "html", "gfm"):
        seed = doc.write_one(gfm(SAMPLE), fmt if fmt != "markdown" else "gfm")
        for i in range(40):
            data = bytearray(seed)
            for _ in range(rng.randint(1, 8)):
                at = rng.randrange(len(data))
                match rng.randrange(3):
                    case 0:
                        data[at] = rng.randrange(256)
                    case 1:
                        del data[at : at + rng.randint(1, 40)]
                    case 2:
                        data[at:at] = data[: rng.randint(1, 30)]
                data = data or bytearray(b"x")
            rows.append((len(rows), fmt, bytes(data)))
    found = doc.parse(spark.createDataFrame(rows, "doc_id long, format string, content binary")).collect()
    assert len(found) == len(rows) and all((r.ast_json is None) == (r.error is not None) for r in found)


def test_nodes_nest(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, "")], "doc_id long, content string")
    rows = [r for r in doc.nodes(doc.parse(df, "gfm")).collect()]
    assert {r.doc_id for r in rows} == {1}
    by = {r.pre: r for r in rows}
    for r in rows:
        if r.parent is not None:
            up = by[r.parent]
            assert up.pre < r.pre and r.post < up.post and r.depth == up.depth + 1
    heads = rel.subtree_text(doc.nodes(doc.parse(df, "gfm")), "Header").collect()
    assert [h.text for h in heads] == ["Title one"]


def numbers_by_hand(levels):
    base, counts, out = min(levels), [0] * 7, []
    for level in levels:
        counts[level] += 1
        counts[level + 1 :] = [0] * (6 - level)
        out.append(".".join(str(c) for c in counts[base : level + 1]))
    return out


def test_section_numbers_and_parents_on_random_outlines(spark):
    rng = random.Random(1)
    docs = {d: [rng.randint(1, 6) for _ in range(rng.randint(1, 25))] for d in range(60)}
    df = spark.createDataFrame([(d, i, level) for d, levels in docs.items() for i, level in enumerate(levels)], "doc_id long, pre int, level int")
    got = {(r.doc_id, r.pre): r.number for r in rel.section_numbers(df).collect()}
    parents = {(r.doc_id, r.pre): r.parent for r in rel.toc(df).collect()}
    for d, levels in docs.items():
        assert [got[d, i] for i in range(len(levels))] == numbers_by_hand(levels)
        shown = [(i, level) for i, level in enumerate(levels) if level <= 3]
        for at, (i, level) in enumerate(shown):
            assert parents[d, i] == next((j for j, k in reversed(shown[:at]) if k < level), None)


def test_filled_text(spark):
    def by_hand(text, width):
        lines = []
        for w in text.split():
            if lines and len(lines[-1]) + 1 + len(w) <= width:
                lines[-1] += " " + w
            else:
                lines.append(w)
        return "\n".join(lines)

    texts = ["", "one", "a bb ccc dddd eeeee", "x" * 30 + " y z", "  lead  and\ntrail  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.filled(F.col("t"), 10).alias("f"))
    assert all(r.f == by_hand(r.t, 10) for r in df.collect())


def test_stream_gives_the_batch_result(spark, tmp_path):
    df = spark.createDataFrame([(i, f"# H{i}\n\n*a*") for i in range(20)], "doc_id long, content string")
    df.write.parquet(str(tmp_path / "in"))
    stream = doc.convert_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "gfm", "html")
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(doc.convert(df, "gfm", "html").collect())


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "b.docx").write_bytes(packages.write_docx(gfm("b")))
    (tmp_path / "c.zip").write_bytes(b"x")
    found = {os.path.basename(r.doc_id): r for r in doc.parse(doc.scan(spark, str(tmp_path))).collect()}
    assert found["a.md"].ast_json and found["b.docx"].ast_json and found["c.zip"].error


def test_one_shuffle_from_documents_to_numbers(spark):
    df = spark.createDataFrame([(1, "# A\n\n## B")], "doc_id long, content string").repartition(4, "doc_id")
    plan = rel.section_numbers(doc.texts(doc.parse(df, "gfm"), ("Header",)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 + 7  # one for the documents, one per reset group


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(queries.ORACLES[name])
    assert columns == sorted(want.columns)
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    plain = lambda v: None if v is None else v.item() if hasattr(v, "item") else v
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows([plain(v) for v in r] for r in got.select(*columns).collect()) == rows([plain(v) for v in r] for r in want.select(quoted).fetchall())


def test_one_reading_serves_all_formats(spark):
    texts = {1: "# A *b*\n\nc[^n] d[^m]\n\n[^n]: e `f`\n[^m]: g\n", 2: None, 3: "> " * 300 + "x", 4: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    made = doc.conversions(df, "gfm", ("docx", "odt", "gfm", "ipynb"))
    found = {(r.doc_id, r.format): (r.output and bytes(r.output), r.error) for r in made.collect()}
    for fmt in ("docx", "odt", "gfm", "ipynb"):
        for r in doc.convert(df, "gfm", fmt).collect():
            whole = r.output.encode() if isinstance(r.output, str) else r.output and bytes(r.output)
            assert found.pop((r.doc_id, fmt)) == (whole, r.error)
    assert not found
    notes = doc.texts(doc.Source(made.where("format <> 'ipynb'").select(F.struct("doc_id", "format").alias("key"), "format", "output"), None, "output", "key"), ("Note",))
    assert sorted((r.doc_id.doc_id, r.doc_id.format, r.text) for r in notes.collect()) == [(1, f, t) for f in ("docx", "gfm", "odt") for t in ("e f", "g")]


def test_notes_are_read_once(spark, tmp_path):
    import __spark_entry__ as entry

    spark.range(3).selectExpr("id AS c_custkey", "concat('C', id) AS c_name", "1 AS c_nationkey", "'s' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    notes = entry.queries()["kept_notes"](spark, str(tmp_path))
    assert notes._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    assert sorted(map(tuple, notes.collect())) == sorted((i, f"body {i}", f) for i in range(3) for f in ("docx", "odt", "gfm"))


ODD = [
    None, "", " ", "\n", "\n\n", "\t", "    code", "  two", "two  ", "a  b", "a \nb", "a\n b", "a  \nb", "a\n\nb", "a\n\n\n  \nb\n", "a\tb\t", "a\r\nb\r", "\ufeffa", "a\u00a0", "\u00a0\na\u2003\n\u00a0b", "a\x01\x0b\x0c\x1fb",
    "*a* **b** ***c*** _d_ __e__", "word***word*** x***", "`a` ``b", "[a](b) ![c](d) [e]", "[a]: b", "<b>a</b> <!-- c --> <a@b.de>", "<div>\na\n</div>", "&amp; &copy; &#65; &amp", "\\a \\* \\\\", "a\\\nb", "\\textbackslash{} ~ ^ {}",
    "# a", "a\n# b", "- a\n- b", "+ a", "* a", "1. a\n2) b", "a\n1. b", "> a", "a\n> b", "a\n---", "a\n===", "---", "***", "```\na\n```", "~~~\na", "| a |\n|---|\n| b |", "a\n    b", "+1 (389) 555", "a #", "x & y < z > \"q\" 'r' $ % | = _",
]
RUNNING = ("doc_asciidoc", "doc_html", "doc_latex", "doc_markdown_round_trip", "doc_plain", "doc_rst", "docx_round_trip", "epub_round_trip", "node_counts", "odt_round_trip", "tree_depths", "html_round_trip")


@pytest.fixture(scope="session")
def odd_documents(spark, tmp_path_factory):
    random_texts = random.Random(7)
    pieces = [" ", "  ", "\n", "\t", "*", "**", "_", "`", "[a](b)", "<i>", "&lt;", "\\", "#", "- ", "1. ", ">", "a", "bc", "~", "\u00a0", "!", "é"]
    texts = ODD + ["".join(random_texts.choices(pieces, k=random_texts.randint(1, 12))) for _ in range(400)]
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1).write.parquet(str(folder / "documents.parquet"))
    return folder


@pytest.mark.parametrize("name", RUNNING)
def test_running_text_stays_what_it_is(spark, odd_documents, name):
    """Texts with marks and irregular white space give what the query's SQL states."""
    gives_its_sql(spark, odd_documents, "documents", name)


def gives_its_sql(spark, folder, table, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    want = con.execute(queries.ORACLES[name]).fetchall()
    columns = [c[0] for c in con.execute("DESCRIBE " + queries.ORACLES[name]).fetchall()]
    found = [tuple(r) for r in queries.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


CUT = ("page_heading_ids", "page_titles")


@pytest.mark.parametrize("name", CUT)
def test_references_cut_short_stay_text(spark, tmp_path, name):
    texts = ["a&amp;&amp;", "a&amp;&amp", "a&am", "a&", "a &copy b", "&quot;a&quot", "a &middot; b&middot", "a &amp;copy; b", "a & b"]
    pages = [(i, f"<html><head><title>{t}</title></head><body><h1>{t}</h1><p>&amp</p></body></html>") for i, t in enumerate(texts)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    gives_its_sql(spark, tmp_path, "pages", name)
