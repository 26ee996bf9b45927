"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import delete, stored, stored_at


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them. Edges run from larger a to smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    """The count of links and two sums of their hashes; a fixed point keeps them."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 28))), F.sum(F.pmod(F.shiftright(h, 28), F.lit(1 << 28)))).first())


def component_roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link, stored: root is the least node that links lead to.

    Each round is stored in the shared folder, so its lineage stays short and a lost executor costs no earlier round;
    the round before is deleted then. Rounds go on until one changes nothing, which takes about the logarithm of the
    longest path. Self links and repeats are dropped; a table without links gives no rows. Joins on a node with many
    links are left to adaptive skew splitting; a star's rows are as many as its links.
    """
    edges, path = stored_at(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    seen = None
    while (now := _digest(edges)) != seen and now[0]:
        after, fresh = stored_at(_small(_large(edges)), "links")
        delete(links.sparkSession, path)
        edges, path, seen = after, fresh, now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    out = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "roots")
    delete(links.sparkSession, path)
    return out
