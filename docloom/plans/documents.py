"""Tables of documents: parsing to trees, rendering, conversion, and the relational node table."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from docloom import ast
from docloom.plans.batches import byte_slices, spread
from docloom.operators.writers import WRITERS, write_text
from docloom.sources import packages
from docloom.sources.html import read_html
from docloom.sources.markdown import DIALECTS, read_markdown

BATCH_BYTES, OUT_ROWS = 8 << 20, 20_000
PACKAGES = {"docx": (packages.read_docx, packages.write_docx), "odt": (packages.read_odt, packages.write_odt), "epub": (packages.read_epub, packages.write_epub), "ipynb": (packages.read_notebook, packages.write_notebook)}
READABLE = (*DIALECTS, "html", "json", *PACKAGES)
WRITABLE = (*WRITERS, "json", *PACKAGES)


def read_one(content: bytes | str, fmt: str) -> tuple[dict, dict[str, bytes]]:
    """The tree and the media of one document. Raises DocumentError."""
    if fmt in PACKAGES:
        return PACKAGES[fmt][0](content if isinstance(content, bytes) else content.encode())
    text = content.decode("utf-8", "replace") if isinstance(content, bytes) else content
    if fmt == "html":
        return read_html(text), {}
    if fmt == "json":
        try:
            doc = json.loads(text)
            return {"pandoc-api-version": doc["pandoc-api-version"], "meta": doc["meta"], "blocks": doc["blocks"]}, {}
        except (ValueError, KeyError, TypeError, RecursionError) as e:
            raise ast.DocumentError(f"not a document tree: {e}") from None
    if fmt in DIALECTS:
        return read_markdown(text, fmt), {}
    raise ast.DocumentError(f"{fmt} can't be read")


def write_one(doc: dict, fmt: str, media: dict[str, bytes] | None = None, columns: int | None = None) -> bytes:
    if fmt in PACKAGES:
        return PACKAGES[fmt][1](doc, media or {})
    if fmt == "json":
        return (ast.dumps(doc) + "\n").encode()
    if fmt in WRITERS:
        return write_text(doc, fmt, columns).encode()
    raise ast.DocumentError(f"{fmt} can't be written")


def attempt(f, *args):
    """(result, None), or (None, message) if the document is refused; one bad row never fails a job."""
    try:
        return f(*args), None
    except Exception as e:  # codecs raise many kinds over damaged bytes
        return None, f"{type(e).__name__}: {e}"[:300]


def _kernel(df: DataFrame, rows, schema: str) -> DataFrame:
    """mapInArrow in slices of at most BATCH_BYTES; rows yields output tuples for an input row, which leave in batches of
    OUT_ROWS as they come. Tables of few files are dealt over the cores first."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def packed(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*part), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for part in byte_slices(batch, BATCH_BYTES):
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    found.extend(rows(*values))
                    while len(found) >= OUT_ROWS:
                        yield packed(found[:OUT_ROWS])
                        del found[:OUT_ROWS]
                if found:
                    yield packed(found)
                    found = []

    return spread(df).mapInArrow(run, schema)


@dataclass
class Source:
    """Documents that are still to be read: nodes(), texts(), cells() and metadata() read and flatten them in one pass,
    without a tree as text in between."""

    columns: DataFrame  # doc_id, content, format

    def __init__(self, docs: DataFrame, fmt: str | None = None, content: str = "content", id_col: str = "doc_id"):
        self.columns = docs.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"), F.lit(fmt).alias("format") if fmt else F.col("format"))


def _of_trees(asts: DataFrame | Source, rows, schema: str) -> DataFrame:
    """(doc_id, *schema): rows(tree) of each document, read from parse()'s rows or from a Source; refused and null ones have none."""
    if isinstance(asts, Source):
        columns = asts.columns

        def each(doc_id, data, kind):
            found, _ = attempt(read_one, data, kind) if data is not None else (None, None)
            return ((doc_id, *r) for r in rows(found[0])) if found else ()
    else:
        columns = asts.select("doc_id", "ast_json")

        def each(doc_id, tree):
            return ((doc_id, *r) for r in rows(json.loads(tree))) if tree else ()

    return _kernel(columns, each, f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, {schema}")


def parse(docs: DataFrame, fmt: str | None = None, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ast_json, error) for every row; without fmt the column `format` names each row's. Null content has a null tree."""
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"), F.lit(fmt).alias("format") if fmt else F.col("format"))

    def rows(doc_id, data, kind):
        if data is None:
            return [(doc_id, None, None)]
        found, error = attempt(read_one, data, kind)
        return [(doc_id, ast.dumps(found[0]) if found else None, error)]

    return _kernel(columns, rows, f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, ast_json string, error string")


def parse_media(docs: DataFrame, fmt: str, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, url, bytes) of the images that each document refers to and holds."""
    columns = docs.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"))

    def rows(doc_id, data):
        found, _ = attempt(read_one, data, fmt) if data is not None else (None, None)
        return [(doc_id, u, b) for u, b in sorted(found[1].items())] if found else []

    return _kernel(columns, rows, f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, url string, bytes binary")


def convert(docs: DataFrame, source: str, target: str, content: str = "content", id_col: str = "doc_id", columns: int | None = None) -> DataFrame:
    """(doc_id, output, error): each row read and written in one pass, images included. output is text, or binary for
    packages; columns is the width to which markdown's paragraphs are filled."""
    rows_in = docs.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"))
    binary = target in PACKAGES and target != "ipynb"

    def one(data):
        doc, media = read_one(data, source)
        out = write_one(doc, target, media, columns)
        return out if binary else out.decode()

    def rows(doc_id, data):
        return [(doc_id, *attempt(one, data))] if data is not None else [(doc_id, None, None)]

    return _kernel(rows_in, rows, f"doc_id {rows_in.schema['doc_id'].dataType.simpleString()}, output {'binary' if binary else 'string'}, error string")


def conversions(docs: DataFrame, source: str, targets: tuple[str, ...], content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, format, output, error) for every row and target: each row is read once and written in all of them. output
    is binary, text as UTF-8."""
    rows_in = docs.select(F.col(id_col).alias("doc_id"), F.col(content).alias("content"))

    copied = lambda tree, t: deepcopy(tree) if t == "ipynb" else tree  # noqa: E731 - its writer renames attachments

    def rows(doc_id, data):
        found, error = attempt(read_one, data, source) if data is not None else (None, None)
        return [(doc_id, t, *(attempt(write_one, copied(found[0], t), t, found[1]) if found else (None, error))) for t in targets]

    return _kernel(rows_in, rows, f"doc_id {rows_in.schema['doc_id'].dataType.simpleString()}, format string, output binary, error string")


def render(asts: DataFrame, target: str) -> DataFrame:
    """(doc_id, output, error) of parse()'s rows."""
    return convert(asts.select("doc_id", "ast_json"), "json", target, "ast_json")


NODE = {
    "pre": "int", "post": "int", "parent": "int", "depth": "int", "ord": "int", "role": "string", "tag": "string", "text": "string", "level": "int",
    "id": "string", "classes": "array<string>", "url": "string", "title": "string",
}


WITH_ATTR = frozenset(("Table", "Figure", "Div", "Span", "Link", "Image", "Code", "CodeBlock"))
_SPACES = frozenset(("Space", "SoftBreak", "LineBreak"))


def flat(blocks: list, tags: frozenset[str] | None = None) -> list[tuple]:
    """The rows of a tree in pre-order; post ranks close the intervals, so x is below y if y.pre < x.pre and x.post < y.post.

    With tags only nodes of those are listed, under the numbers that they have among all.
    """
    out: list = []
    pres = posts = 0

    def visit(node, parent, level, place, role):
        nonlocal pres, posts
        t, pre = node["t"], pres
        pres += 1
        wanted = tags is None or t in tags
        at = len(out)
        if t == "Str":
            if wanted:
                out.append((pre, posts, parent, level, place, role, t, node["c"], None, None, None, None, None))
            posts += 1
            return
        if t in _SPACES:
            if wanted:
                out.append((pre, posts, parent, level, place, role, t, None, None, None, None, None, None))
            posts += 1
            return
        if wanted:
            out.append(None)
        c, n = node.get("c"), 0
        for slot, (inner_role, inner) in enumerate(ast.kids(node)):
            own = inner_role if inner_role in ("content", "alt") else f"{inner_role}:{slot}"
            for k in inner:
                visit(k, pre, level + 1, n, own)
                n += 1
        if wanted:
            a = c[1] if t == "Header" else c[0] if t in WITH_ATTR else None
            text = c[1] if t in ("Code", "CodeBlock", "RawBlock", "RawInline", "Math") else None
            target = c[2] if t in ("Link", "Image") else (None, None)
            out[at] = (pre, posts, parent, level, place, role, t, text, c[0] if t == "Header" else c[0][0] if t == "OrderedList" else None, a[0] if a else None, a[1] if a else None, target[0], target[1])
        posts += 1

    for i, b in enumerate(blocks):
        visit(b, None, 0, i, "content")
    return out


def nodes(asts: DataFrame | Source, tags: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The node table of parse()'s rows or of a Source; refused documents have no nodes. tags and columns name what is
    wanted of it, so that the rest never leaves the reader."""
    kept, at = frozenset(tags) if tags else None, [list(NODE).index(c) for c in columns or NODE]
    pick = (lambda r: r) if columns is None else itemgetter(*at) if len(at) > 1 else (lambda r: (r[at[0]],))
    return _of_trees(asts, lambda doc: map(pick, flat(doc["blocks"], kept)), ", ".join(f"{c} {NODE[c]}" for c in columns or NODE))


def node_counts(asts: DataFrame | Source, tags: tuple[str, ...]) -> DataFrame:
    """(doc_id, one long per tag, depth): how many nodes of each tag a tree holds, and how deep it is nested."""

    def rows(doc):
        found, depth = ast.tallies(doc["blocks"])
        return [(*(found.get(t, 0) for t in tags), depth)]

    return _of_trees(asts, rows, "".join(f"`{t}` long, " for t in tags) + "depth int")


def texts(asts: DataFrame | Source, tags: tuple[str, ...]) -> DataFrame:
    """(doc_id, pre, tag, level, id, text): running text of every node of the tags, notes inside it left out."""

    def rows(doc):
        return [(i, n["t"], n["c"][0] if n["t"] == "Header" else None, n["c"][1][0] if n["t"] == "Header" else None, ast.text_of(n["c"] if n["t"] == "Note" else [n])) for i, n in enumerate(ast.walk(doc["blocks"])) if n["t"] in tags]

    return _of_trees(asts, rows, "pre int, tag string, level int, id string, text string")


def cells(asts: DataFrame | Source) -> DataFrame:
    """(doc_id, table, section, row, col, row_span, col_span, align, text) of all tables."""

    def rows(doc):
        for t, table in enumerate(n["c"] for n in ast.walk(doc["blocks"]) if n["t"] == "Table"):
            for section, r, row in ast.cells_of(table):
                for i, c in enumerate(row):
                    yield t, section, r, i, c[2], c[3], c[1]["t"], ast.text_of(c[4])

    return _of_trees(asts, rows, "table int, section string, row int, col int, row_span int, col_span int, align string, text string")


def columns(asts: DataFrame | Source) -> DataFrame:
    """(doc_id, table, col, align, width) of all tables' columns; width is a share of the line, null where none is given."""

    def rows(doc):
        for t, table in enumerate(n["c"] for n in ast.walk(doc["blocks"]) if n["t"] == "Table"):
            for i, (align, width) in enumerate(table[2]):
                yield t, i, align["t"], width.get("c")

    return _of_trees(asts, rows, "table int, col int, align string, width double")


def metadata(asts: DataFrame | Source) -> DataFrame:
    """(doc_id, key, ord, value) of all metadata, as text."""
    from docloom.operators.writers import meta_texts

    return _of_trees(asts, lambda doc: [(k, i, v) for k, m in sorted(doc["meta"].items()) for i, v in enumerate(meta_texts(m))], "key string, ord int, value string")


def capabilities(spark: SparkSession) -> DataFrame:
    """(format, readable, writable, packaged) of all formats; packaged ones hold their images."""
    names = ", ".join(f"('{f}', {f in READABLE}, {f in WRITABLE}, {f in PACKAGES and f != 'ipynb'})".lower() for f in sorted({*READABLE, *WRITABLE}))
    return spark.sql(f"SELECT * FROM VALUES {names} AS f(format, readable, writable, packaged)")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, format, content) of the files under path; doc_id is the path, formats go by extension."""
    from docloom.functions.text import format_of_path

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("doc_id"), format_of_path(F.col("path")).alias("format"), "content")


def convert_stream(stream: DataFrame, source: str, target: str, content: str = "content", id_col: str = "doc_id") -> DataFrame:
    """convert() over a streaming table: it keeps no state, so any trigger and output mode that appends will do."""
    return convert(stream, source, target, content, id_col)


def data_url(data: bytes, kind: str) -> str:
    return f"data:{kind};base64,{base64.b64encode(data).decode()}"
