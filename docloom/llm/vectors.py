"""Exact top-k search: a KD-tree per shard, searched best first with bounds that other shards have proven."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import stored

LEAF = 256  # vectors of a leaf
SHARD = 1 << 13  # vectors of a shard, about
BLOCK = 1 << 13  # queries that a task searches for at once, about
PILOT = 4096  # vectors that prove first bounds, about
EXACT = 1 << 53  # sums of whole numbers below it are exact in doubles


class KDTree:
    """Median splits along the widest side of each node's bounding box; boxes are tight around their vectors."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.spans: list[tuple[int, int]] = []
        self.kids: list[tuple[int, int] | None] = []
        self.low, self.high = [], []
        self._split(vectors, 0, len(vectors))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.vectors = np.ascontiguousarray(vectors[self.order])

    def _split(self, vectors: np.ndarray, start: int, stop: int) -> int:
        own = vectors[self.order[start:stop]]
        at = len(self.spans)
        self.spans.append((start, stop))
        self.kids.append(None)
        self.low.append(own.min(axis=0))
        self.high.append(own.max(axis=0))
        if stop - start > LEAF:
            side = int((self.high[at] - self.low[at]).argmax())
            half = (stop - start) // 2
            part = np.argpartition(own[:, side], half)
            self.order[start:stop] = self.order[start:stop][part]
            self.kids[at] = (self._split(vectors, start, start + half), self._split(vectors, start + half, stop))
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query the (scores, ids, rows) of its best k inner products here that aren't under its floor, its own
        row left out; ties to smaller ids, then rows. ids and rows are in the order of the tree's input.

        A node's bound is the largest inner product that its box allows. Nodes are opened best first, until the best
        bound is under the k-th score found so far or under the floor, which searches elsewhere have proven.
        """
        ids, rows = ids[self.order], rows[self.order]
        # bounds of all nodes for all queries: positive parts meet the upper side of a box, negative ones the lower
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        # beyond EXACT sums of doubles are rounded: bounds are raised by as much
        width = np.abs(queries) @ np.maximum(np.abs(self.high), np.abs(self.low)).T * queries.shape[1]
        bounds = np.where(width < EXACT, bounds, bounds + width * 2.0**-51)
        out = []
        for q, skip, floor, limit in zip(queries, own, floors, bounds):
            heap, best_s, best_i, best_r = [(-limit[0], 0)], np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.int64)
            kth = floor
            while heap and -heap[0][0] >= kth:
                at = heapq.heappop(heap)[1]
                if self.kids[at]:
                    for kid in self.kids[at]:
                        if limit[kid] >= kth:
                            heapq.heappush(heap, (-limit[kid], kid))
                    continue
                part = slice(*self.spans[at])
                scores = products(self.vectors[part], q)
                hit = np.flatnonzero((scores >= kth) & (rows[part] != skip))
                if not len(hit):
                    continue
                best_s, best_i, best_r = np.concatenate([best_s, scores[hit]]), np.concatenate([best_i, ids[part][hit]]), np.concatenate([best_r, rows[part][hit]])
                first = np.array(sorted(range(len(best_s)), key=lambda x: (-best_s[x], best_i[x], best_r[x]))[:k]) if best_s.dtype == object else np.lexsort((best_r, best_i, -best_s))[:k]
                best_s, best_i, best_r = best_s[first], best_i[first], best_r[first]
                if len(best_s) == k:
                    kth = max(kth, best_s[-1])
            out.append((best_s, best_i, best_r))
        return out


def products(block: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of vectors of whole numbers: doubles where no sum can reach EXACT, else Python's integers."""
    if np.abs(block).max(initial=0) * np.abs(q).max(initial=0) * max(1, len(q)) < EXACT:
        return block @ q
    whole = [int(x) for x in q.tolist()]
    return np.array([sum(int(x) * y for x, y in zip(v, whole)) for v in block.tolist()] + [None], object)[:-1]


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row, id, v), stored, with v = floor(scale * x) of each component x and a number for each row; vectors that are null,
    empty or hold nulls, NaN or infinities are left out, like null ids. Rows that repeat an id stay; other columns aren't looked at."""
    # doubles from 2**53 on are whole numbers, and floor() to a long would cut them off
    whole = lambda y: F.when(F.abs(y) < F.lit(float(EXACT)), F.floor(y).cast("double")).otherwise(y)
    as_double = F.transform(vector_col, lambda x: x.cast("double"))
    usable = F.size(vector_col) > 0
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable & F.coalesce(sound, F.lit(False)))
    return stored(good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.transform(as_double, lambda x: whole(F.lit(float(scale)) * x)).alias("v")), "vectors")


def _matrix(column) -> np.ndarray:
    return np.array(column.to_list() if hasattr(column, "to_list") else list(column), dtype=np.float64)


def _found(queries, results):
    """Rows (query, query_id, vec_id, row, score, about): score is exact within a long's range and its end beyond it."""
    import pandas as pd

    at = [i for i, (s, _, _) in enumerate(results) for _ in range(len(s))]
    scores = [int(x) for s, _, _ in results for x in s]
    flat = lambda n: np.concatenate([r[n] for r in results]) if results else np.empty(0, np.int64)
    return pd.DataFrame({
        "query": queries.row.to_numpy(np.int64)[at] if at else np.empty(0, np.int64), "query_id": queries.id.to_numpy(np.int64)[at] if at else np.empty(0, np.int64),
        "vec_id": flat(1).astype(np.int64), "row": flat(2).astype(np.int64),
        "score": np.array([min(max(x, -(2**63)), 2**63 - 1) for x in scores], np.int64), "about": np.array([float(x) for x in scores], np.float64),
    })


_FOUND = "query long, query_id long, vec_id long, row long, score long, about double"


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query row among vectors, its own row left out.

    vectors and queries are (row, id, v) of quantised(), stored, of one width (others are never compared). Each query
    row has a ranking of its own, also where rows repeat an id. Scores are exact; one beyond a long's range is given as
    the end of the range and ranked by its value as a double. Ties go to smaller ids, then to earlier rows.

    First a bounded pilot, about PILOT vectors picked by a hash, proves a floor under each query's k-th score. Then the
    vectors are dealt by hash into shards of about SHARD and the queries into blocks of about BLOCK; each shard meets
    each block in a task of its own, builds its KD-tree and searches it with the pilot's floors. At most k rows per
    query and shard go on to the last ranking.
    """
    vectors = vectors.withColumn("d", F.size("v"))
    queries = stored(queries.withColumn("d", F.size("v")), "queries")  # with columns of its own, though it may be a part of vectors
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    part = lambda seed, count: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(count))
    pilot = vectors.where(part("pilot", max(1, n // PILOT)) == 0)

    blocked = queries.withColumn("block", part("block", blocks))
    floors_of = _searched(pilot.withColumn("shard", F.lit(0)), blocked.withColumn("floor", F.lit(float("-inf"))), 1, blocks, k)
    # a double at most as large as the k-th score
    floors = floors_of.groupBy("query").agg(F.count("*").alias("n"), F.min("about").alias("about")).where(F.col("n") >= k).select(F.col("query").alias("row"), (F.col("about") - F.abs("about") * 2.0**-50).alias("floor"))
    armed = stored(blocked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "query-floors")
    found = _searched(vectors.withColumn("shard", part("shard", shards)), armed, shards, blocks, k)
    order = Window.partitionBy("query").orderBy(F.desc("about"), F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(vectors: DataFrame, queries: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """What each shard's tree finds for each block of queries, as _found() lists it."""
    left = vectors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).select("shard", "block", "d", "row", "id", "v")
    right = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).select("shard", "block", "d", "row", "id", "v", "floor")
    left = left.withColumn("shard", F.col("shard").cast("long"))

    def search(ours, theirs):
        if not len(ours) or not len(theirs):
            return _found(theirs, [])
        tree = KDTree(_matrix(ours.v))
        return _found(theirs, tree.search(_matrix(theirs.v), theirs.row.to_numpy(np.int64), ours.id.to_numpy(np.int64), ours.row.to_numpy(np.int64), theirs.floor.to_numpy(), k))

    keys = ["shard", "block", "d"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, _FOUND)
