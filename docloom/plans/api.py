"""A fluent table of documents, and table functions for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import ast
from docloom.plans import documents as doc


class Documents:
    """Parsed documents: `Documents.read(df, "gfm").render("html")`. Each method is one plan over the same trees."""

    def __init__(self, asts: DataFrame):
        self.asts = asts

    @classmethod
    def read(cls, docs: DataFrame, fmt: str | None = None, content: str = "content", id_col: str = "doc_id") -> Documents:
        return cls(doc.parse(docs, fmt, content, id_col))

    def nodes(self) -> DataFrame:
        return doc.nodes(self.asts)

    def cells(self) -> DataFrame:
        return doc.cells(self.asts)

    def metadata(self) -> DataFrame:
        return doc.metadata(self.asts)

    def headings(self) -> DataFrame:
        return doc.texts(self.asts, ("Header",))

    def render(self, target: str) -> DataFrame:
        return doc.render(self.asts, target)

    def errors(self) -> DataFrame:
        return self.asts.where("error is not null").select("doc_id", "error")


class _Blocks:
    def eval(self, content: str, fmt: str):
        found, _ = doc.attempt(doc.read_one, content, fmt) if content is not None else (None, None)
        for i, b in enumerate(found[0]["blocks"] if found else []):
            yield i, b["t"], ast.text_of([b])


class _Links:
    def eval(self, content: str, fmt: str):
        found, _ = doc.attempt(doc.read_one, content, fmt) if content is not None else (None, None)
        for i, n in enumerate(x for x in ast.walk(found[0]["blocks"]) if x["t"] == "Link") if found else ():
            yield i, ast.text_of([n]), n["c"][2][0], n["c"][2][1]


class _Cells:
    def eval(self, content: str, fmt: str):
        found, _ = doc.attempt(doc.read_one, content, fmt) if content is not None else (None, None)
        tables = [n["c"] for n in ast.walk(found[0]["blocks"]) if n["t"] == "Table"] if found else []
        for t, table in enumerate(tables):
            for section, r, row in ast.cells_of(table):
                for i, c in enumerate(row):
                    yield t, section, r, i, ast.text_of(c[4])


def register(spark: SparkSession) -> None:
    """doc_blocks, doc_links and doc_cells as table functions for LATERAL joins; each row of content is read on its own."""
    spark.udtf.register("doc_blocks", F.udtf(_Blocks, returnType="ord int, tag string, text string"))
    spark.udtf.register("doc_links", F.udtf(_Links, returnType="ord int, text string, url string, title string"))
    spark.udtf.register("doc_cells", F.udtf(_Cells, returnType="`table` int, section string, row int, col int, text string"))
