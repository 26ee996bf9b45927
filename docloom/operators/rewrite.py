"""Rewrites and look-ups over node tables: links and anchors, numbering, tables, lists, and comparison of trees.

All are keyed by document: joins are equi-joins on doc_id and a key, windows see one document (or table, or list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def linked_anchors(anchors: DataFrame, links: DataFrame) -> DataFrame:
    """anchors (doc_id, id, ...) that a link (doc_id, url) of their document points to; orphans go."""
    targets = links.where(F.col("url").startswith("#")).select("doc_id", F.substring("url", 2, 2**31 - 1).alias("id"))
    return anchors.join(targets, ["doc_id", "id"], "left_semi")


def repointed(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """links with url "#name" turned into "#id" where anchors (doc_id, name, id) know the name; other urls stay."""
    known = anchors.select("doc_id", F.concat(F.lit("#"), "name").alias("url"), F.concat(F.lit("#"), "id").alias("__to")).dropDuplicates(["doc_id", "url"])
    return links.join(known, ["doc_id", "url"], "left").withColumn("url", F.coalesce("__to", "url")).drop("__to")


def numbering_levels(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame, overrides: DataFrame) -> DataFrame:
    """paragraphs (doc_id, num, level, ...) with the format and start of their level, by the tables of their document:
    num -> abstract -> level, overrides first."""
    found = paragraphs.join(nums.select("doc_id", "num", "abstract"), ["doc_id", "num"], "left").join(levels.select("doc_id", "abstract", "level", "format", "start"), ["doc_id", "abstract", "level"], "left")
    found = found.join(overrides.select("doc_id", "num", "level", F.col("start").alias("__start")), ["doc_id", "num", "level"], "left")
    return found.withColumn("start", F.coalesce("__start", "start")).drop("__start", "abstract")


def reading_order(spine: DataFrame, manifest: DataFrame) -> DataFrame:
    """spine (doc_id, pos, idref) joined to manifest (doc_id, id, href), places numbered from 0; unknown ids drop out."""
    found = spine.join(manifest.select("doc_id", F.col("id").alias("idref"), "href"), ["doc_id", "idref"])
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)


def grouped_metadata(fields: DataFrame, single: tuple[str, ...] = ("title",)) -> DataFrame:
    """fields (doc_id, key, ord, value) -> (doc_id, key, values): the last value of keys in single, else all in order."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    grouped = fields.groupBy("doc_id", "key").agg(values.alias("values"))
    return grouped.withColumn("values", F.when(F.col("key").isin(*single), F.slice("values", -1, 1)).otherwise(F.col("values")))


def column_counts(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table, row, col_span) -> (doc_id, table, columns): the widest row's sum of spans."""
    rows = cells.groupBy("doc_id", "table", "row").agg(F.sum("col_span").alias("n"))
    return rows.groupBy("doc_id", "table").agg(F.max("n").alias("columns"))


def column_widths(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table, col, text) -> (doc_id, table, col, width): the length of a column's longest cell."""
    return cells.groupBy("doc_id", "table", "col").agg(F.max(F.char_length("text")).alias("width"))


def column_shares(columns: DataFrame) -> DataFrame:
    """columns (doc_id, table, col, width) with share: widths that sum to more than 1 are scaled to sum to 1."""
    total = F.sum("width").over(Window.partitionBy("doc_id", "table"))
    return columns.withColumn("share", F.when(total > 1, F.col("width") / total).otherwise(F.col("width")))


def column_alignments(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table, row, col, align) -> (doc_id, table, col, align): that of a column's first cell."""
    return cells.groupBy("doc_id", "table", "col").agg(F.min_by("align", "row").alias("align"))


def loose_lists(children: DataFrame) -> DataFrame:
    """children (doc_id, list, tag) of list items -> (doc_id, list, loose): a list is loose if an item holds a Para."""
    return children.groupBy("doc_id", "list").agg(F.bool_or(F.col("tag") == "Para").alias("loose"))


def noted_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links (doc_id, url, ...) with body: that of the note (doc_id, id, body) of their document that "#id" names; others have none and stay links."""
    found = notes.select("doc_id", F.concat(F.lit("#"), "id").alias("url"), "body").dropDuplicates(["doc_id", "url"])
    return links.join(found, ["doc_id", "url"], "left")


def item_numbers(items: DataFrame, levels: int = 9) -> DataFrame:
    """items (doc_id, pre, num, level from 0) with number: counted per num and level, anew after an item of a lesser level of that num."""
    before = Window.partitionBy("doc_id", "num").orderBy("pre")
    scope = F.lit(0)
    for k in range(1, levels):
        scope = F.when(F.col("level") == k, F.count_if(F.col("level") < k).over(before)).otherwise(scope)
    w = Window.partitionBy("doc_id", "num", "level", "__scope").orderBy("pre")
    return items.withColumn("__scope", scope).withColumn("number", F.row_number().over(w)).drop("__scope")


def note_numbers(notes: DataFrame) -> DataFrame:
    """notes (doc_id, pre) with number, from 1 in document order; an outer note comes before those inside it."""
    return notes.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")))


def registered(uses: DataFrame, key: str, prefix: str, name: str = "name") -> DataFrame:
    """uses (doc_id, pre, key) with a generated name: prefix and the key's place by first use in its document."""
    first = F.min("pre").over(Window.partitionBy("doc_id", key))
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("__first"))
    return uses.withColumn("__first", first).withColumn(name, F.concat(F.lit(prefix), place.cast("string"))).drop("__first")


def first_matches(nodes: DataFrame, tag: str, value: str) -> DataFrame:
    """(doc_id, value) of each document's first node of a tag."""
    return nodes.where(F.col("tag") == tag).groupBy("doc_id").agg(F.min_by(value, "pre").alias(value))


def inside_first(nodes: DataFrame, match) -> DataFrame:
    """Nodes within the first node of their document that match selects, itself included; all nodes where none does."""
    tops = nodes.where(match).groupBy("doc_id").agg(F.min_by(F.struct("pre", "post"), "pre").alias("__top"))
    kept = nodes.join(tops, "doc_id", "left")
    return kept.where(F.col("__top").isNull() | ((F.col("pre") >= F.col("__top.pre")) & (F.col("post") <= F.col("__top.post")))).drop("__top")


def trimmed(tokens: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, token) without white space before a document's first word and after its last."""
    word, w = F.when(F.trim("token", F.lit(" \t\r\n")) != "", F.col("pos")), Window.partitionBy("doc_id")
    return tokens.withColumn("__a", F.min(word).over(w)).withColumn("__b", F.max(word).over(w)).where(F.col("pos").between(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def without_space_at_breaks(inlines: DataFrame) -> DataFrame:
    """inlines (doc_id, pos, tag) without a Space next to a LineBreak."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    at_break = (F.lead("tag").over(w) == "LineBreak") | (F.lag("tag").over(w) == "LineBreak")
    return inlines.withColumn("__drop", (F.col("tag") == "Space") & F.coalesce(at_break, F.lit(False))).where("not __drop").drop("__drop")


def too_deep(nodes: DataFrame, most: int = 200) -> DataFrame:
    """(doc_id, depth) of documents nested deeper than most."""
    return nodes.groupBy("doc_id").agg((F.max("depth") + 1).alias("depth")).where(F.col("depth") > most)


def first_divergence(left: DataFrame, right: DataFrame, columns: tuple[str, ...] = ("tag", "text", "depth")) -> DataFrame:
    """(doc_id, pre): the first node at which two node tables differ; documents that agree aren't listed."""
    side = lambda df, name: df.select("doc_id", "pre", F.struct(*columns).alias(name))
    both = side(left, "l").join(side(right, "r"), ["doc_id", "pre"], "full")
    return both.where(~F.col("l").eqNullSafe(F.col("r"))).groupBy("doc_id").agg(F.min("pre").alias("pre"))
