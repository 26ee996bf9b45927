"""Sharding by a K-d tree over metadata: weighted medians found by distributed histograms, leaves of near-equal bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import stored

PART = 20  # bits of each of a key's parts: value, hash of the group, hash of the row
PARTS = 3  # a cut is refined by a part per pass
SLACK = 0.004  # of a leaf's target: a cut may miss its median by so much to keep equal texts together
NUMBERED = 100_000  # rows of a shard that are numbered in one group, about
DIMS = ("bytes", "lang", "density")


@dataclass
class Node:
    """shards leaves below; cut: (dimension, first key of the right child) once split; else a leaf numbered from first."""

    first: int
    shards: int
    cut: tuple[str, int] | None = None
    kids: list[Node] = field(default_factory=list)


def key_of(value: Column, group: Column, row: Column) -> Column:
    """A 60-bit key that orders by a 20-bit value, then by a hash of the group, then by one of the row: a cut can part rows of one value."""
    bits = lambda h: F.pmod(h, F.lit(2**PART))
    return F.shiftleft(value.cast("long"), 2 * PART) + F.shiftleft(bits(group), PART) + bits(row)


def _constant(values: list, kind: str) -> Column:
    """values as one constant array: neither jobs nor joins nor generated code come of it, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _of_node(known: dict[int, float], kind: str) -> Column:
    """What is known of a row's node; -1 or null of others."""
    return F.get(_constant([known.get(i, -1) for i in range(max(known) + 1)], kind), F.col("node"))


def _descended(points: DataFrame, levels: list[list[Node]], dims: tuple[str, ...]) -> DataFrame:
    """points with node, the first shard below the node of the tree so far that a row falls into: a walk down constant arrays."""
    tree, lefts = [levels[0][0]] if levels else [Node(0, 1)], []
    for n in tree:  # grows meanwhile; a right child follows its left one
        lefts.append(len(tree) if n.kids else 0)
        tree += n.kids
    left, first = _constant(lefts, "int"), _constant([n.first for n in tree], "int")
    dim = _constant([dims.index(n.cut[0]) if n.cut else -1 for n in tree], "int")
    at = _constant([n.cut[1] if n.cut else 0 for n in tree], "long")
    right = lambda i: F.coalesce(F.get(F.array(*dims), F.get(dim, i)) >= F.get(at, i), F.lit(False)).cast("int")
    down = lambda i, _: F.when(F.get(left, i) > 0, F.get(left, i) + right(i)).otherwise(i)
    return points.withColumn("node", F.get(first, F.aggregate(_constant(range(len(levels)), "int"), F.lit(0), down)) if levels else F.lit(0))


def _medians(digits: DataFrame, goal: Column) -> DataFrame:
    """A row for each node and dim of digits (node, dim, size, digit): its size w, its least and greatest digit lo and
    hi, and m, the first digit up to which the size reaches goal (a column of node and w), with its size and the size up
    to it. Rows without a digit don't count. They aren't filtered out, as a filter would walk the tree once more."""
    own = Window.partitionBy("node", "dim")
    hist = digits.groupBy("node", "dim", "digit").agg(F.sum(F.when(F.col("digit").isNotNull(), F.col("size"))).alias("of"))
    hist = hist.withColumn("upto", F.sum("of").over(own.orderBy("digit"))).withColumn("w", F.sum("of").over(own))
    reached = F.when(F.col("digit").isNotNull() & (F.col("upto") >= goal), F.struct("digit", F.col("of").alias("w"), "upto"))
    return hist.groupBy("node", "dim").agg(F.first("w").alias("w"), F.min("digit").alias("lo"), F.max("digit").alias("hi"), F.min(reached).alias("m"))


def build(points: DataFrame, shards: int, dims: tuple[str, ...] = DIMS, slack: float = SLACK) -> list[list[Node]]:
    """The tree over points (size, and a 60-bit key per dimension) with `shards` leaves of near-equal total size: its
    inner nodes, level by level.

    Per level one histogram of each node's values in every dimension finds the dimension that is widest, by the share of
    the root's range that its values span, and the value that its weighted median has. Where that value's size is over
    slack of a leaf, the hashes of its groups, then of its rows refine the cut, a pass each. A node of k leaves is cut at
    floor(k/2)/k of its size. A few numbers per node reach the driver; a pass groups by at most 2**PART digits per node
    and dimension. A pass is one job without joins, so what the driver keeps of jobs and plans stays small.
    """
    levels: list[list[Node]] = []
    todo = [Node(0, shards)] if shards > 1 else []
    spans: list[int] = []
    while todo:
        at = _descended(points, levels, dims)
        half, whole = _of_node({n.first: n.shards // 2 for n in todo}, "int"), _of_node({n.first: n.shards for n in todo}, "int")
        values = [F.struct(F.lit(i).alias("dim"), F.when(half > 0, F.shiftright(d, PART * (PARTS - 1))).alias("digit")) for i, d in enumerate(dims)]
        found: dict[int, dict] = {}
        for r in _medians(at.select("node", "size", F.inline(F.array(*values))), F.col("w").cast("double") * half / whole).collect():
            if r["m"] is not None:
                found.setdefault(r["node"], {})[r["dim"]] = r
        spans = spans or [max(1, found[0][i]["hi"] - found[0][i]["lo"]) if 0 in found else 1 for i in range(len(dims))]
        limit = slack * sum(f[0]["w"] for f in found.values()) / sum(n.shards for n in todo)
        state, cuts = {}, {}  # by first shard: [dimension, key of the cut so far, size left of the goal]; the key of the cut
        for n in todo:
            if (f := found.get(n.first)) is not None:
                dim = max(f, key=lambda i: ((f[i]["hi"] - f[i]["lo"]) / spans[i], -i))
                state[n.first] = [dim, 0, f[dim]["w"] * (n.shards // 2) / n.shards]
        medians = {k: found[k][x[0]]["m"] for k, x in state.items()}
        for part in range(PARTS):
            shift = PART * (PARTS - 1 - part)
            if part and (left := {k: x for k, x in state.items() if k not in cuts}):
                dim, prefix, goal = [_of_node({k: x[j] for k, x in left.items()}, kind) for j, kind in enumerate(("int", "long", "double"))]
                keyed = at.select("node", "size", dim.alias("dim"), prefix.alias("prefix"), F.get(F.array(*dims), dim).alias("key"))
                digit = F.when(F.shiftright("key", shift + PART) == F.col("prefix"), F.shiftright("key", shift))
                medians = {r["node"]: r["m"] for r in _medians(keyed.select("node", "size", "dim", digit.alias("digit")), goal).collect() if r["m"] is not None}
            for k, m in medians.items():
                below, goal = m["upto"] - m["w"], state[k][2]
                if m["w"] <= limit or part == PARTS - 1:
                    cuts[k] = (m["digit"] + (goal - below > m["upto"] - goal)) << shift
                state[k][1:] = m["digit"], goal - below
            if len(cuts) == len(state):
                break
        for n in todo:
            # a node without rows can be cut anywhere
            n.cut = (dims[state[n.first][0]], cuts[n.first]) if n.first in cuts else (dims[0], 2 ** (PART * PARTS))
            n.kids = [Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)]
        levels.append(todo)
        todo = [k for n in todo for k in n.kids if k.shards > 1]
    return levels


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) for every row of docs; law is `bytes`.

    size is the text's UTF-8 bytes and overhead; null text has no bytes, and the CRC of none. Either the number of
    shards or the bytes that a shard should have is given. Dimensions are the text's bytes (log scale), its language (by
    falling frequency, nulls a language) and its bytes per character. Each dimension's ties are ordered by content, then
    by id and row, so equal texts with an equal language share a shard unless their group is heavier than a cut's slack,
    and repeated rows, of null ids too, can be parted like others. Sources aren't a dimension, as they part equal texts.
    An empty table gives an empty result. slot numbers a shard's rows from 0 without gaps.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    log = lambda x, scale: F.greatest(F.least(F.log2(x) * F.lit(scale), F.lit(2.0**20 - 1)), F.lit(0.0)).cast("long")
    dense = log(F.when(F.char_length(text) > 0, size / F.char_length(text)).otherwise(1.0), 2.0**18)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (size + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g"),
        F.monotonically_increasing_id().alias("row"), log(size + 1, 2.0**14).alias("b"), F.col(lang_col).alias("l"), dense.alias("d"),
    )
    rows = stored(rows, "shard-rows")
    langs = rows.groupBy(F.col("l").alias("of")).agg(F.count("*").alias("n"))
    rank = F.least(F.row_number().over(Window.orderBy(F.desc("n"), F.col("of").asc_nulls_last())) - 1, F.lit(2**20 - 1))
    langs = stored(langs.select("of", rank.alias("rank")).coalesce(1), "shard-langs")
    tie = F.xxhash64("doc_id", "row")
    points = rows.join(langs, F.col("l").eqNullSafe(F.col("of")), "left")
    points = points.select("doc_id", "size", "text_crc32", "row", *[key_of(F.col(v), F.col("g"), tie).alias(d) for d, v in zip(DIMS, ("b", "rank", "d"))])
    points = stored(points, "shard-points")
    totals = points.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    if shards is None:
        shards = max(1, -(-(totals["size"] or 0) // target_bytes))
    levels = build(points, shards) if totals["n"] else []
    placed = _descended(points.select("doc_id", "size", "text_crc32", "row", *DIMS), levels, DIMS).withColumnRenamed("node", "shard")
    return slots(placed, max(1, totals["n"] // (shards * NUMBERED))).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")


def slots(placed: DataFrame, buckets: int) -> DataFrame:
    """placed (shard, doc_id, row, ...) with slot: a row's place in its shard, from 0. Rows are numbered within hash
    buckets of a shard, each after the rows of the buckets before it, so that no task holds a whole shard."""
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")))
    joined = numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.withColumn("slot", (F.col("start") + F.col("at") - 1).cast("long"))
