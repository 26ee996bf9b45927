"""Document operations that relate nodes to each other, as windows, joins and aggregations keyed by document.

Windows are partitioned by document (or table, or list), so their groups are as large as one document at most. A corpus
is repartitioned by doc_id once; what follows reuses that partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVELS = 9  # of headings; office formats have as many


def section_numbers(headings: DataFrame) -> DataFrame:
    """headings (doc_id, pre, level, ...) with number: dotted counters from the document's least level; a counter starts
    anew after a heading of a lesser level. Rows whose `unnumbered` is true neither get nor use up a number."""
    base = F.min("level").over(Window.partitionBy("doc_id"))
    plain = F.coalesce(~F.col("unnumbered"), F.lit(True)) if "unnumbered" in headings.columns else F.lit(True)
    rows = headings.withColumn("base", base).where(plain)
    order = Window.partitionBy("doc_id").orderBy("pre")
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"g{k}", F.count_if(F.col("level") < k).over(order))
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"c{k}", F.count_if(F.col("level") == k).over(Window.partitionBy("doc_id", f"g{k}").orderBy("pre")))
    counts = F.array(*[F.col(f"c{k}").cast("string") for k in range(1, LEVELS + 1)])
    number = F.array_join(F.slice(counts, F.col("base"), F.greatest("level", "base") - F.col("base") + 1), ".")
    return rows.withColumn("number", number).drop("base", *[f"{x}{k}" for k in range(1, LEVELS + 1) for x in "gc"])


def toc(headings: DataFrame, deepest: int = 3) -> DataFrame:
    """Headings of levels up to deepest with parent, the pre of the last earlier heading of a lesser level."""
    rows = headings.where(F.col("level") <= deepest)
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast("int")
    for k in range(2, deepest + 1):
        last = F.last_value(F.when(F.col("level") < k, F.col("pre")), ignoreNulls=True) if hasattr(F, "last_value") else None
        last = F.last(F.when(F.col("level") < k, F.col("pre")), ignorenulls=True).over(before) if last is None or not isinstance(last, Column) else last.over(before)
        parent = F.when(F.col("level") == k, last).otherwise(parent)
    return rows.withColumn("parent", parent)


def unique_ids(rows: DataFrame, group: str, order: str, base: str, name: str = "id") -> DataFrame:
    """rows with ids: the first of a base in its group keeps it, later ones get -1, -2 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(group, base).orderBy(order)) - 1
    return rows.withColumn(name, F.when(n > 0, F.concat_ws("-", base, n)).otherwise(F.col(base)))


def resolved(refs: DataFrame, definitions: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """refs with the value that their document defines for key; without a definition, default."""
    found = refs.join(definitions.select("doc_id", key, value), ["doc_id", key], "left")
    return found.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else found


def used_media(media: DataFrame, nodes: DataFrame) -> DataFrame:
    """Media (doc_id, url, ...) that an Image of their document refers to."""
    return media.join(nodes.where("tag = 'Image'").select("doc_id", "url"), ["doc_id", "url"], "left_semi")


def subtree_text(nodes: DataFrame, tag: str) -> DataFrame:
    """(doc_id, pre, text) of each node of a tag: what its interval of the node table holds, in order."""
    piece = F.when(F.col("tag").isin("Space", "SoftBreak", "LineBreak"), F.lit(" ")).otherwise(F.col("text"))
    leaves = nodes.select("doc_id", F.col("pre").alias("at"), F.col("post").alias("end"), piece.alias("piece")).where("piece is not null")
    tops = nodes.where(F.col("tag") == tag).select("doc_id", "pre", "post")
    inside = tops.join(leaves, (tops.doc_id == leaves.doc_id) & (leaves.at > tops.pre) & (leaves.end < tops.post)).select(tops.doc_id, "pre", "at", "piece")
    joined = inside.groupBy("doc_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return tops.select("doc_id", "pre").join(joined, ["doc_id", "pre"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def chapters(blocks: DataFrame) -> DataFrame:
    """Top-level rows (doc_id, pre, level) with chapter: how many headings of level 1 stand before or at them."""
    return blocks.withColumn("chapter", F.count_if(F.col("level") == 1).over(Window.partitionBy("doc_id").orderBy("pre")))


def runs(rows: DataFrame, group: list[str], order: str, value: str, name: str = "run") -> DataFrame:
    """rows with the number, from 0, of their run of equal values in order within group (nulls are a value)."""
    w = Window.partitionBy(*group).orderBy(order)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    starts = rows.withColumn("__change", F.when(F.row_number().over(w) == 1, 0).otherwise(change))
    return starts.withColumn(name, F.sum("__change").over(w)).drop("__change")


def list_sessions(items: DataFrame) -> DataFrame:
    """items (doc_id, pre, level, num) with list: a new one starts where the level falls or, at one level, num changes."""
    w = Window.partitionBy("doc_id").orderBy("pre")
    level, num = F.lag("level").over(w), F.lag("num").over(w)
    fresh = level.isNull() | (F.col("level") < level) | ((F.col("level") == level) & (F.col("num") != num))
    return items.withColumn("__fresh", fresh.cast("int")).withColumn("list", F.sum("__fresh").over(w)).drop("__fresh")


def row_spans(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table, row, col, merged) -> (doc_id, table, row, col, row_span): merged cells belong to the nearest unmerged one above."""
    w = Window.partitionBy("doc_id", "table", "col").orderBy("row")
    tops = cells.withColumn("top", F.sum(F.when(F.col("merged"), 0).otherwise(1)).over(w))
    return tops.groupBy("doc_id", "table", "col", "top").agg(F.min("row").alias("row"), F.count("*").alias("row_span")).select("doc_id", "table", "row", "col", "row_span")


def grid_columns(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table, row, cell, col_span, and row_span if there are any) with grid_col, the first column that a
    cell covers: after the cells before it in its row, columns under longer cells of earlier rows skipped.

    Without row_span that is a running sum. With it a table's cells are placed one after the other: a table is a row of
    arrays then, and a batch of tables is one call of Python.
    """
    if "row_span" not in cells.columns:
        before = Window.partitionBy("doc_id", "table", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        return cells.withColumn("grid_col", F.coalesce(F.sum("col_span").over(before), F.lit(0)).cast("long"))

    @F.pandas_udf("array<long>")
    def places(row: pd.Series, wide: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([grid_places(zip(*x)) for x in zip(row, wide, high)], dtype=object)

    rest = [c for c in cells.columns if c not in ("doc_id", "table", "row", "cell")]
    tables = cells.groupBy("doc_id", "table").agg(F.sort_array(F.collect_list(F.struct("row", "cell", *rest))).alias("__cells"))
    tables = tables.withColumn("__at", places("__cells.row", "__cells.col_span", "__cells.row_span"))
    found = tables.select("doc_id", "table", F.explode(F.arrays_zip("__cells", "__at")).alias("__x"))
    return found.select("doc_id", "table", "__x.__cells.*", F.col("__x.__at").alias("grid_col")).select(*cells.columns, "grid_col")


def grid_places(cells) -> list[int]:
    """The first column of each of a table's cells (row, col_span, row_span), given row by row."""
    covered: dict[int, int] = {}  # column: the row from which it is free again
    out, at, now = [], 0, None
    for row, wide, high in cells:
        if row != now:
            at, now = 0, row
        while covered.get(at, row) > row:
            at += 1
        out.append(at)
        for column in range(at, at + max(1, int(wide))):
            covered[column] = row + max(1, int(high))
        at += max(1, int(wide))
    return out


def style_names(styles: DataFrame, hops: int = 16) -> DataFrame:
    """styles (doc_id, id, name, based_on) -> (doc_id, id, hop, name) of each style and those of its document that it is
    based on, nearest first, at most hops. Chains of 2^k styles are joined to those that begin 2^k styles on, so 16 hops
    take four rounds of joins, and no number of rows ends them."""
    chains = styles.select("doc_id", "id", F.lit(0).alias("hop"), "name")
    ahead = styles.where("based_on IS NOT NULL").select("doc_id", "id", F.col("based_on").alias("far"))
    reach = 1
    while reach < hops:
        further = chains.select("doc_id", F.col("id").alias("far"), (F.col("hop") + reach).alias("hop"), "name").where(F.col("hop") < hops)
        chains, near = chains.unionByName(ahead.join(further, ["doc_id", "far"]).select("doc_id", "id", "hop", "name")), ahead
        reach *= 2
        if reach < hops:
            beyond = near.select("doc_id", F.col("id").alias("far"), F.col("far").alias("beyond"))
            ahead = near.join(beyond, ["doc_id", "far"]).select("doc_id", "id", F.col("beyond").alias("far"))
    return chains


def caption_pairs(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, pre, kind), siblings in order -> (doc_id, pre, caption): each `table` or `image` with the pre of
    the `caption` beside it. One before it is taken first, one after it if that is no other's; each belongs to one at most."""
    w = Window.partitionBy("doc_id").orderBy("pre")
    body = lambda c: c.isin("table", "image")
    near = blocks.withColumn("b", F.lag("kind").over(w)).withColumn("bp", F.lag("pre").over(w)).withColumn("a", F.lead("kind").over(w)).withColumn("ap", F.lead("pre").over(w))
    # runs of caption and body in turns are paired from their start on
    turn = F.col("kind") == "caption"
    start = ~((turn & body(F.coalesce("b", F.lit("")))) | (body(F.col("kind")) & (F.col("b") == "caption")))
    runs_ = near.where(turn | body(F.col("kind"))).withColumn("run", F.sum(F.coalesce(start, F.lit(True)).cast("int")).over(w))
    placed = runs_.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("pre")))
    first = placed.where("n % 2 = 1").select("doc_id", "run", "n", "pre", "kind")
    second = placed.where("n % 2 = 0").select("doc_id", "run", (F.col("n") - 1).alias("n"), F.col("pre").alias("mate"))
    both = first.join(second, ["doc_id", "run", "n"], "left")
    found = both.select("doc_id", F.when(F.col("kind") == "caption", F.col("mate")).otherwise(F.col("pre")).alias("pre"), F.when(F.col("kind") == "caption", F.col("pre")).otherwise(F.col("mate")).alias("caption"))
    return found.where("pre IS NOT NULL")


def score(results: DataFrame, ours: str, theirs: str) -> DataFrame:
    """(matched, total, percent) of rows whose two columns agree."""
    same = F.col(ours).eqNullSafe(F.col(theirs))
    return results.agg(F.count_if(same).alias("matched"), F.count("*").alias("total"), F.round(F.avg(same.cast("double")) * 100, 2).alias("percent"))
