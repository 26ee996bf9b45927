"""Queries over documents made of relational rows and taken through each format: what comes back is stated in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom import conformance
from docloom.functions import marks
from docloom.operators import relational as rel
from docloom.plans import documents as doc
from docloom.queries import query, table

# ---- one document per customer with most kinds of blocks and inlines

_TEMPLATE = """# {name}

Segment **{seg}** and nation *{nation}* with `code {k}` and ~~gone {k}~~.

- alpha {k}
- beta {k}

3. one {k}
4. two {k}

> quoted {k}

| key | name |
|----:|:-----|
| {k} | N {k} |

``` python
x = {k}
```

See [link {k}](http://x.example/{k} "t").

---

Last {k}{note}.
"""
_WANTED = ("Header", "Strong", "Emph", "Strikeout", "Code", "CodeBlock", "BlockQuote", "Link", "Plain", "OrderedList", "BulletList", "HorizontalRule", "Table")


def _customers(spark, sf_dir, note: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    text = F.lit(_TEMPLATE)
    for name, value in (("name", F.col("c_name")), ("seg", F.col("c_mktsegment")), ("nation", F.col("c_nationkey").cast("string")), ("note", F.lit("[^a]" if note else "")), ("k", key)):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return c.select(F.col("c_custkey").cast("long").alias("doc_id"), F.concat(text, F.concat(F.lit("\n[^a]: body "), key, F.lit("\n")) if note else F.lit("")).alias("content"))


_OFFICE = """
WITH c AS (SELECT c_custkey::BIGINT AS doc_id, c_name AS name, c_mktsegment AS seg, c_nationkey::VARCHAR AS nation, c_custkey::VARCHAR AS k FROM customer)
SELECT doc_id, t.tag, t.level::INT AS level, t.text FROM c, LATERAL (VALUES
  ('Header', 1, name), ('Strong', NULL, seg), ('Emph', NULL, nation), ('Code', NULL, 'code ' || k), ('Strikeout', NULL, 'gone ' || k),
  ('BulletList', NULL, 'alpha ' || k || 'beta ' || k), ('Plain', NULL, 'alpha ' || k), ('Plain', NULL, 'beta ' || k),
  ('OrderedList', NULL, 'one ' || k || 'two ' || k), ('Plain', NULL, 'one ' || k), ('Plain', NULL, 'two ' || k), ('BlockQuote', NULL, 'quoted ' || k),
  ('Table', NULL, 'keyname' || k || 'N ' || k), ('Plain', NULL, 'key'), ('Plain', NULL, 'name'), ('Plain', NULL, k), ('Plain', NULL, 'N ' || k),
  ('CodeBlock', NULL, 'x = ' || k), ('Link', NULL, 'link ' || k), ('HorizontalRule', NULL, '')) t(tag, level, text)
"""


def _through(fmt: str):
    def run(spark, sf_dir):
        content = _customers(spark, sf_dir)
        if fmt != "gfm":
            content = doc.convert(content, "gfm", fmt).select("doc_id", F.col("output").alias("content"))
        return doc.texts(doc.Source(content, fmt), _WANTED).select("doc_id", "tag", "level", "text")

    run.__name__, run.__doc__ = f"office_{fmt}", f"Documents written as {fmt} and read again, by kind of node."
    return query(_OFFICE)(run)


for _fmt in ("gfm", "docx", "odt", "epub", "html", "json"):
    _through(_fmt)


@query("""
SELECT c_custkey::BIGINT AS doc_id, r::INT AS row, col::INT AS col, CASE WHEN r = 0 THEN CASE col WHEN 0 THEN 'key' ELSE 'name' END WHEN col = 0 THEN c_custkey::VARCHAR ELSE 'N ' || c_custkey END AS text
FROM customer, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) x(r, col)
""")
def docx_cells(spark, sf_dir):
    """Tables of DOCX files as cells."""
    made = doc.convert(_customers(spark, sf_dir), "gfm", "docx")
    return doc.cells(doc.Source(made, "docx", "output")).select("doc_id", "row", "col", "text")


@query("SELECT c_custkey::BIGINT AS doc_id, 'body ' || c_custkey AS text, f AS format FROM customer, (VALUES ('docx'), ('odt'), ('gfm')) x(f)")
def kept_notes(spark, sf_dir):
    """Footnotes through formats that have them: documents are read once, written in each format, and read again."""
    made = doc.conversions(_customers(spark, sf_dir, True), "gfm", ("docx", "odt", "gfm"))
    notes = doc.texts(doc.Source(made.select(F.struct("doc_id", "format").alias("key"), "format", "output"), None, "output", "key"), ("Note",))
    return notes.select("doc_id.doc_id", "text", "doc_id.format")


@query("""
SELECT p_partkey AS doc_id, t.key, t.ord::INT AS ord, t.value FROM part, LATERAL (VALUES ('author', 0, p_brand), ('author', 1, 'b' || p_partkey), ('draft', 0, 'true'), ('title', 0, p_name)) t(key, ord, value)
""")
def front_matter(spark, sf_dir):
    """Metadata at the head of extended markdown."""
    return doc.metadata(doc.Source(_with_metadata(spark, sf_dir), "markdown"))


def _with_metadata(spark, sf_dir) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nauthor:\n- "), "p_brand", F.lit("\n- b"), key, F.lit("\ndraft: true\n---\n\nterm "), key, F.lit("\n:   body "), key, F.lit("\n\nH~2~O x^2^\n")).alias("content"))


@query("""
SELECT p_partkey AS doc_id, t.key, t.ord::INT AS ord, t.value FROM part, LATERAL (VALUES ('author', 0, p_brand), ('author', 1, 'b' || p_partkey), ('title', 0, p_name)) t(key, ord, value)
""")
def docx_metadata(spark, sf_dir):
    """Title and authors as leading paragraphs of DOCX files."""
    return doc.metadata(doc.Source(doc.convert(_with_metadata(spark, sf_dir), "markdown", "docx"), "docx", "output"))


@query("""
SELECT p_partkey AS doc_id, t.tag, t.text, f AS format FROM part, (VALUES ('markdown'), ('docx'), ('html')) x(f), LATERAL (VALUES ('DefinitionList', 'term ' || p_partkey || 'body ' || p_partkey), ('Subscript', '2'), ('Superscript', '2')) t(tag, text)
""")
def definitions(spark, sf_dir):
    """Definition lists, and text above and below the line, through formats that have them."""
    made, out = _with_metadata(spark, sf_dir), None
    for fmt in ("markdown", "docx", "html"):
        source = doc.Source(made, fmt) if fmt == "markdown" else doc.Source(doc.convert(made, "markdown", fmt), fmt, "output")
        rows = doc.texts(source, ("DefinitionList", "Subscript", "Superscript")).select("doc_id", "tag", "text", F.lit(fmt).alias("format"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""
SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS item, o_orderstatus = 'F' AS done, 'order ' || o_orderkey AS text FROM orders
""")
def task_items(spark, sf_dir):
    """Task lists with a box per order, read from GFM, written as HTML and read again."""
    line = F.concat(F.lit("- ["), F.when(F.col("o_orderstatus") == "F", "x").otherwise(" "), F.lit("] order "), F.col("o_orderkey").cast("string"))
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("ls"))
    made = lists.select("doc_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))
    items = doc.texts(doc.Source(made, "gfm"), ("Plain",))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
    return items.select("doc_id", place.alias("item"), marks.task_state(F.col("text")).alias("done"), F.substring("text", 3, 1000).alias("text"))


@query("""
SELECT n_regionkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS chapter, n_name AS title, 'ch' || lpad(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::VARCHAR, 3, '0') || '.xhtml' AS file FROM nation
""")
def books(spark, sf_dir):
    """EPUBs of a region with a chapter per nation: titles and files in the order of the spine."""
    part = F.concat(F.lit("# "), "n_name", F.lit("\n\nNation "), F.col("n_nationkey").cast("string"), F.lit(".\n\n"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", part.alias("part")))).alias("ps"))
    made = rows.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.array_join(F.transform("ps", lambda x: x["part"]), "").alias("content"))
    nodes = doc.nodes(doc.Source(doc.convert(made, "commonmark", "epub"), "epub", "output"), ("Span", "Header"), ("pre", "tag", "level", "id"))
    files = nodes.where("tag = 'Span'").select("doc_id", F.col("id").alias("file"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("chapter"))
    heads = doc.texts(doc.Source(doc.convert(made, "commonmark", "epub"), "epub", "output"), ("Header",))
    titles = heads.select("doc_id", F.col("text").alias("title"), F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")).alias("chapter"))
    return files.join(titles, ["doc_id", "chapter"]).select("doc_id", "chapter", "title", "file")


@query("""
SELECT kind, count(*) FILTER (WHERE ok)::BIGINT AS ok, count(*) FILTER (WHERE NOT ok)::BIGINT AS refused FROM part, (VALUES ('cut docx', false), ('cut epub', false), ('cut gfm', true), ('cut html', true), ('deep gfm', false), ('no json', false)) x(kind, ok) GROUP BY kind
""")
def hostile(spark, sf_dir):
    """Damaged and too deep documents are refused row by row, never with the job."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("# "), "p_name", F.lit("\n\n- *a* `b\n> <p <b>[c](d")).alias("content"))
    out = None

    def add(kind, rows):
        nonlocal out
        counted = rows.agg(F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("refused")).select(F.lit(kind).alias("kind"), "ok", "refused")
        out = counted if out is None else out.unionByName(counted)

    cut = lambda c: F.expr(f"substring({c}, 1, cast(octet_length({c}) / 2 as int))")
    for fmt in ("docx", "epub"):
        packed = doc.convert(base, "commonmark", fmt).select("doc_id", cut("output").alias("content"))
        add(f"cut {fmt}", doc.parse(packed, fmt))
    add("cut gfm", doc.parse(base.select("doc_id", cut("content").alias("content")), "gfm"))
    add("cut html", doc.parse(base.select("doc_id", F.concat(F.lit("<div><table><tr><td>"), cut("content"), F.lit("<ul><li")).alias("content")), "html"))
    add("deep gfm", doc.parse(base.select("doc_id", F.concat(F.repeat(F.lit("> "), 300), F.lit("x")).alias("content")), "gfm"))
    add("no json", doc.parse(base, "json"))
    return out


@query("""
SELECT p_partkey AS doc_id, p_name || p_partkey AS text, f AS format FROM part, (VALUES ('ipynb'), ('docx'), ('odt'), ('epub')) x(f)
""")
def carried_media(spark, sf_dir):
    """Images of notebooks' outputs, and the same images out of the packages that the notebooks were converted to."""
    data = F.base64(F.concat("p_name", F.col("p_partkey").cast("string")).cast("binary"))
    out = F.array(F.struct(F.lit("display_data").alias("output_type"), F.create_map(F.lit("image/png"), data).alias("data"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata")))
    cell = F.struct(F.lit("code").alias("cell_type"), F.lit("c").alias("id"), F.lit("x").alias("source"), out.alias("outputs"))
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.to_json(F.struct(F.array(cell).alias("cells"), F.lit(4).alias("nbformat"))).alias("content"))
    found = doc.parse_media(made, "ipynb").withColumn("format", F.lit("ipynb"))
    for fmt in ("docx", "odt", "epub"):
        packed = doc.convert(made, "ipynb", fmt).select("doc_id", F.col("output").alias("content"))
        found = found.unionByName(doc.parse_media(packed, fmt).withColumn("format", F.lit(fmt)))
    return found.select("doc_id", F.col("bytes").cast("string").alias("text"), "format")


@query("""
SELECT * FROM (VALUES ('asciidoc', false, true, false), ('commonmark', true, true, false), ('docx', true, true, true), ('epub', true, true, true), ('gfm', true, true, false), ('html', true, true, false),
  ('ipynb', true, true, false), ('json', true, true, false), ('latex', false, true, false), ('markdown', true, false, false), ('odt', true, true, true), ('plain', false, true, false), ('rst', false, true, false)) f(format, readable, writable, packaged)
""")
def capabilities(spark, sf_dir):
    return doc.capabilities(spark)


@query("SELECT doc_id, text = text AS same FROM documents")
def json_round_trip(spark, sf_dir):
    """Trees as JSON, read and written again: not a byte changes."""
    trees = doc.parse(table(spark, sf_dir, "documents"), "commonmark", "text")
    again = doc.render(trees, "json").select("doc_id", F.rtrim(F.col("output"), F.lit("\n")).alias("again"))
    return trees.join(again, "doc_id").select("doc_id", (F.col("ast_json") == F.col("again")).alias("same"))


@query("""
SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?s)<(script|style|head|title)[^>]*>.*?</(script|style|head|title)>', '', 'g'), '<h1>'))::BIGINT AS headings FROM pages
""")
def page_headings(spark, sf_dir):
    """Headings of pages; scripts, styles and heads hold none."""
    return doc.node_counts(doc.Source(table(spark, sf_dir, "pages"), "html", "html", "page_id"), ("Header",)).select(F.col("doc_id").alias("page_id"), F.col("Header").alias("headings"))


@query("SELECT section, total::BIGINT AS matched, total::BIGINT AS total, 100.0::DOUBLE AS percent FROM (VALUES " + ", ".join(f"('{s}', {n})" for s, n in conformance.totals().items()) + ") t(section, total)")
def commonmark_sections(spark, sf_dir):
    """Cases of the CommonMark and GFM specifications by section: HTML written from what was read against the expected one."""
    cases = spark.createDataFrame([(i, *c) for i, c in enumerate(conformance.CASES)], "doc_id int, section string, format string, content string, expected string")
    out = None
    for fmt in ("commonmark", "gfm"):
        html = doc.convert(cases.where(F.col("format") == fmt), fmt, "html").select("doc_id", "output")
        out = html if out is None else out.unionByName(html)
    return cases.join(out, "doc_id").groupBy("section").agg(
        F.count_if(F.col("output").eqNullSafe(F.col("expected"))).alias("matched"), F.count("*").alias("total"), F.round(F.avg(F.col("output").eqNullSafe(F.col("expected")).cast("double")) * 100, 2).alias("percent")
    )


@query("""
SELECT p_partkey AS doc_id, t.tag, t.id, t.url, t.text FROM part, LATERAL (VALUES
  ('Note', NULL, NULL, 'note ' || p_partkey), ('Link', '', '#gone', 'see'), ('Span', 'i' || p_partkey, NULL, 'item'), ('Div', 'j' || p_partkey, NULL, 'long item'),
  ('Image', '', 'data:image/svg+xml;base64,' || to_base64(encode('<svg width="' || p_size || '"></svg>')), '')) t(tag, id, url, text)
""")
def html_parts(spark, sf_dir):
    """Main content by its role, notes and their references, ids of list items, and drawings in the text."""
    part = table(spark, sf_dir, "part")
    page = F.lit("""<p>before</p><div role="main"><p>T<a href="#n{k}" role="doc-noteref">1</a> <a href="#gone" role="doc-noteref">see</a></p>
<ul><li id="i{k}">item</li><li id="j{k}"><p>long item</p></li></ul><p><svg width="{s}"></svg></p></div>
<section role="doc-endnotes"><ol><li id="n{k}"><p>note {k} <a href="#r" role="doc-backlink">back</a></p></li></ol></section>""")
    for name, value in (("k", F.col("p_partkey")), ("s", F.col("p_size"))):
        page = F.replace(page, F.lit("{" + name + "}"), value.cast("string"))
    nodes = doc.nodes(doc.Source(part.select(F.col("p_partkey").alias("doc_id"), page.alias("content")), "html"))
    out = None
    for tag in ("Note", "Link", "Span", "Div", "Image"):
        own = nodes.where(F.col("tag") == tag).select("doc_id", "pre", "tag", "id", "url")
        texts = rel.subtree_text(nodes, tag).join(own, ["doc_id", "pre"]).select("doc_id", "tag", "id", "url", F.trim("text").alias("text"))
        out = texts if out is None else out.unionByName(texts)
    return out


@query("""
SELECT p_partkey AS doc_id, 0 AS "table", col::INT AS col, CASE col WHEN 0 THEN p_size % 100 / 100.0::DOUBLE ELSE (100 - p_size % 100) / 100.0::DOUBLE END AS share FROM part, (VALUES (0), (1)) c(col)
""")
def html_widths(spark, sf_dir):
    """Column widths of tables."""
    part = table(spark, sf_dir, "part")
    size = (F.col("p_size") % 100).cast("string")
    page = F.concat(F.lit('<table><col style="width: '), size, F.lit('%"><col width="'), (100 - F.col("p_size") % 100).cast("string"), F.lit('%"><tr><td>a</td><td>b</td></tr></table>'))
    return doc.columns(doc.Source(part.select(F.col("p_partkey").alias("doc_id"), page.alias("content")), "html")).select("doc_id", "table", "col", F.round("width", 4).alias("share"))


@query("""
SELECT p_partkey AS doc_id, 'k' || p_size AS kernel, 'print(' || p_partkey || ')' AS source, 'out ' || p_partkey AS stream, to_base64(encode(p_name)) AS png, 'b' || p_size AS json, 'E' || p_size AS ename, 'line 1|line ' || p_partkey AS trace,
  'see ![i](attachment:a.png) ' || p_partkey AS note, to_base64(encode(p_brand)) AS attached FROM part
""")
def notebook_round_trip(spark, sf_dir):
    """Notebooks read and written again: outputs of each kind, attachments and metadata stay."""
    part = table(spark, sf_dir, "part")
    text = F.lit("""{"cells": [{"cell_type": "code", "id": "c1", "execution_count": 3, "source": ["print({k})"], "outputs": [
 {"output_type": "stream", "name": "stdout", "text": ["out {k}"]}, {"output_type": "display_data", "data": {"image/png": "{png}", "text/plain": "x"}, "metadata": {}},
 {"output_type": "execute_result", "execution_count": 3, "data": {"application/json": {"a": "b{s}"}}, "metadata": {}}, {"output_type": "error", "ename": "E{s}", "evalue": "v", "traceback": ["line 1", "line {k}"]}]},
 {"cell_type": "markdown", "id": "m1", "source": "see ![i](attachment:a.png) {k}", "attachments": {"a.png": {"image/png": "{brand}"}}}], "metadata": {"kernelspec": {"language": "k{s}"}}, "nbformat": 4}""")
    coded = lambda c: F.regexp_replace(F.base64(F.col(c).cast("binary")), "\r\n", "")
    for name, value in (("png", coded("p_name")), ("brand", coded("p_brand")), ("k", F.col("p_partkey").cast("string")), ("s", F.col("p_size").cast("string"))):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    again = doc.convert(part.select(F.col("p_partkey").alias("doc_id"), text.alias("content")), "ipynb", "ipynb")
    at = lambda path: F.get_json_object("output", path)
    o = "$.cells[0].outputs"
    joined = lambda path, by: F.array_join(F.from_json(at(path), "array<string>"), by)
    return again.select(
        "doc_id", at("$.metadata.kernelspec.language").alias("kernel"), joined("$.cells[0].source", "").alias("source"), joined(f"{o}[0].text", "").alias("stream"), at(f"{o}[1].data['image/png']").alias("png"),
        at(f"{o}[2].data['application/json'].a").alias("json"), at(f"{o}[3].ename").alias("ename"), joined(f"{o}[3].traceback", "|").alias("trace"), joined("$.cells[1].source", "").alias("note"), at("$.cells[1].attachments['a.png']['image/png']").alias("attached"),
    )


@query()
def markdown_filled(spark, sf_dir):
    """Documents as markdown with lines of up to 60 columns; tests hold it against a loop over words."""
    return doc.convert(table(spark, sf_dir, "documents"), "commonmark", "commonmark", "text", columns=60).select("doc_id", "output")
