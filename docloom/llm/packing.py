"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_map, stored
from docloom.llm.tokens import encoder

ITEMS = 8192  # pieces of a block, about
ISLANDS, EPOCHS = 2, 2
POPULATION, GENERATIONS = 8, 6  # of an island and an epoch, where best fit misses the bound


def cut_pieces(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n tokens: whole pieces of `most`, a shorter one first."""
    if n <= most:
        return [(0, n)]
    first = n % most or most
    return [(0, first), *((at, most) for at in range(first, n, most))]


def pieces(docs: DataFrame, tokenizer: tuple, most: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids, which end with end_id; null text counts as empty."""

    def rows(columns):
        out: list[list] = [[], [], [], [], []]
        for doc, ids in zip(columns[0], encoder(*tokenizer).encode([t or "" for t in columns[1]])):
            data = np.array([*ids, end_id], "<u4")
            for n, (start, length) in enumerate(cut_pieces(len(data), most)):
                for column, value in zip(out, (doc, n, start, length, zlib.crc32(data[start : start + length].tobytes()))):
                    column.append(value)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), rows, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, order: np.ndarray, assign: np.ndarray, fills: list[int], most: int) -> list[int]:
    """Places the items of `order` one by one, each in the bin with the least room that holds it, else in a new one.

    assign is written; fills, the bins' loads so far, is extended and returned. Bins are found by room in a bit set.
    """
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms = 0
    for b, fill in enumerate(fills):
        if fill < most:
            by_room[most - fill].append(b)
            rooms |= 1 << (most - fill)
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), most
            fills.append(0)
        assign[item] = b
        fills[b] += length
        if room > length:
            by_room[room - length].append(b)
            rooms |= 1 << (room - length)
    return fills


class Solution:
    """Bins of all items. Better has fewer bins, then the greater sum of squared fills."""

    def __init__(self, assign: np.ndarray, fills: np.ndarray):
        self.assign, self.fills = assign, fills
        self.rank = (len(fills), -float((fills.astype(float) ** 2).sum()))

    @classmethod
    def of(cls, assign: np.ndarray, lengths: np.ndarray) -> Solution:
        labels, assign = np.unique(assign, return_inverse=True)
        return cls(assign, np.bincount(assign, weights=lengths, minlength=len(labels)).astype(np.int64))


def fresh(lengths: np.ndarray, most: int, rng: np.random.Generator, noise: float) -> Solution:
    """Best fit in falling order of length, the order blurred by noise."""
    order = np.argsort(-lengths * (1 + noise * rng.random(len(lengths))), kind="stable")
    assign = np.empty(len(lengths), np.int64)
    return Solution(assign, np.array(best_fit(lengths, order, assign, [], most)))


def exchanged(loose: np.ndarray, assign: np.ndarray, fills: list[int], lengths: np.ndarray, most: int) -> np.ndarray:
    """Puts each loose item, longest first, in place of the shorter item whose bin it then fills best, if there is one;
    returns the items that are loose then. Bins only get fuller, and what stays loose is shorter. assign and fills are written."""
    assign[loose] = -1
    if not fills:
        return loose
    room, out = most - np.array(fills, np.int64), []
    for item in loose[np.argsort(-lengths[loose], kind="stable")].tolist():
        gain = lengths[item] - lengths
        left = np.where((assign >= 0) & (gain > 0), room[assign] - gain, -1)
        left = np.where(left >= 0, left, most + 1)
        at = int(left.argmin())
        if left[at] > most:
            out.append(item)
            continue
        b = int(assign[at])
        assign[item], assign[at] = b, -1
        fills[b] += int(gain[at])
        room[b] -= gain[at]
        out.append(at)
    return np.array(out, np.int64)


def crossover(giver: Solution, taker: Solution, lengths: np.ndarray, most: int, rng: np.random.Generator) -> Solution:
    """Injects about half of the giver's well-filled bins into the taker, the fuller the likelier: bins of the taker that
    share an item with them are dissolved, and what they held besides is placed anew."""
    good = giver.fills >= max(np.median(giver.fills), 0.98 * most)
    slack = (most - giver.fills) / max(1, most - int(giver.fills.min()))
    picked = good & (rng.random(len(good)) < 0.7 - 0.4 * slack)
    injected = picked[giver.assign]
    dissolved = np.zeros(len(taker.fills), bool)
    dissolved[taker.assign[injected]] = True
    loose = ~injected & dissolved[taker.assign]
    # bins of both parents get new numbers side by side
    number_g, number_t = np.cumsum(picked) - 1, np.cumsum(~dissolved) - 1 + int(picked.sum())
    assign = np.where(injected, number_g[giver.assign], number_t[taker.assign])
    fills = [*giver.fills[picked].tolist(), *taker.fills[~dissolved].tolist()]
    left = np.flatnonzero(loose)
    best_fit(lengths, left[np.argsort(-lengths[left], kind="stable")], assign, fills, most)
    return Solution(assign, np.array(fills))


def mutated(one: Solution, lengths: np.ndarray, most: int, rng: np.random.Generator) -> Solution:
    """Dissolves the emptiest bins and a few others; their items are exchanged for shorter ones, and what is loose then
    is placed by best fit, longest first."""
    n = len(one.fills)
    gone = np.zeros(n, bool)
    gone[np.argsort(one.fills)[: max(2, n // 100)]] = True
    gone[rng.random(n) < max(0.01, min(0.1, 2 / n))] = True
    number = np.cumsum(~gone) - 1
    assign, fills = number[one.assign], one.fills[~gone].tolist()
    loose = exchanged(np.flatnonzero(gone[one.assign]), assign, fills, lengths, most)
    best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], assign, fills, most)
    return Solution(assign, np.array(fills))


def evolve(lengths: np.ndarray, most: int, seed: int, elites: list[Solution], population: int = POPULATION, generations: int = GENERATIONS) -> Solution:
    """The best solution after some generations of an island that starts from elites and fresh ones. It ends early when
    a solution has as few bins as the sum of lengths allows."""
    least = -(-int(lengths.sum()) // most)
    rng = np.random.default_rng(seed)
    alive = list(elites)
    if not alive:
        alive = [fresh(lengths, most, rng, 0.0)]
    best = min(alive, key=lambda s: s.rank)
    if best.rank[0] <= least:
        return best
    while len(alive) < population:
        alive.append(fresh(lengths, most, rng, 0.05 * len(alive)))
    for _ in range(generations):
        alive.sort(key=lambda s: s.rank)
        if alive[0].rank[0] <= least:
            break
        half = alive[: max(2, population // 2)]
        young = []
        for _ in range(population - population // 2):
            a, b = rng.permutation(len(half))[:2]
            young.append(mutated(crossover(half[a], half[b], lengths, most, rng), lengths, most, rng))
        alive = [*half, *young]
    return min(alive, key=lambda s: s.rank)


def _packed(items: DataFrame, most: int, blocks: int, seed: int) -> DataFrame:
    """(uid, block, bin, offset, weak) for every row of items (uid, length), packed within hash blocks; weak marks a
    block's least full bin and those that are at most half full.

    Each block is solved on ISLANDS islands. After each epoch an island's best solution goes on to its next epoch and,
    as migrant, to the island beside it; at last the block's best one is taken. All groups have about ITEMS rows.
    """
    import pandas as pd

    def solutions(pdf):
        lengths, found, uids = None, [], None
        for _, part in pdf.groupby("origin", sort=True):
            part = part.sort_values("uid", kind="stable")
            uids, lengths = part.uid.to_numpy(), part.length.to_numpy()
            if part.bin.iloc[0] >= 0:
                found.append(Solution.of(part.bin.to_numpy(), lengths))
        return uids, lengths, found

    def epoch(pdf):
        block, island, n = int(pdf.block.iloc[0]), int(pdf.island.iloc[0]), int(pdf.epoch.iloc[0])
        uids, lengths, elites = solutions(pdf)
        best = evolve(lengths, most, hash((seed, block, island, n)) & 0x7FFFFFFF, elites)
        return pd.DataFrame({"block": block, "island": island, "origin": island, "epoch": n + 1, "uid": uids, "length": lengths, "bin": best.assign})

    def last(pdf):
        block = int(pdf.block.iloc[0])
        uids, lengths, elites = solutions(pdf)
        best = min(elites, key=lambda s: s.rank)
        order = np.lexsort((uids, best.assign))
        ends = np.cumsum(lengths[order])
        bins = best.assign[order]
        starts = np.r_[0, np.flatnonzero(np.diff(bins)) + 1]
        before = np.repeat(ends[starts] - lengths[order][starts], np.diff(np.r_[starts, len(bins)]))
        weak = (best.fills * 2 <= most) | (np.arange(len(best.fills)) == best.fills.argmin())
        return pd.DataFrame({"uid": uids[order], "block": block, "bin": bins, "offset": ends - lengths[order] - before, "weak": weak[bins]})

    schema = "block long, island int, origin int, epoch int, uid long, length long, bin long"
    block = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(blocks)).alias("block")
    rows = items.select(block, F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.lit(0).alias("origin"), F.lit(0).alias("epoch"), "uid", "length", F.lit(-1).cast("long").alias("bin"))
    for n in range(EPOCHS):
        rows = rows.groupBy("block", "island").applyInPandas(epoch, schema)
        if n + 1 < EPOCHS:
            rows = rows.withColumn("island", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)))
    return rows.groupBy("block").applyInPandas(last, "uid long, block long, bin long, offset long, weak boolean")


def pack(docs: DataFrame, tokenizer: tuple, most: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs.

    A row's ids end with end_id and are cut into pieces of `most` ids only if they are more, a shorter piece first.
    Null text has end_id alone. Null ids and repeated rows are packed each for itself. An empty table gives an empty
    result. Whole pieces fill a sequence each. The others are packed in blocks of about ITEMS; if there are several, what
    stands in sequences that are at most half full, or in a block's least full one, is packed once more, in fewer blocks,
    so that not every block leaves a rest.
    """
    cut = stored(pieces(docs, tokenizer, most, end_id, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    items = cut.where(F.col("length") < most).select("uid", "length")
    n = items.count()
    whole = cut.where(F.col("length") == most).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not n:
        return cut.join(whole, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    number = lambda turn: (F.lit(1).cast("long") * (1 << 62) + F.col("block") * F.lit(1 << 20) + F.col("bin") * 2 + turn)
    blocks = -(-n // ITEMS)
    first = stored(_packed(items, most, blocks, 1), "packed")
    placed = whole.unionByName(first.where(F.lit(blocks == 1) | ~F.col("weak")).select("uid", number(0).alias("sequence_id"), "offset"))
    if blocks > 1:
        rest = first.where("weak").select("uid")
        again = stored(_packed(items.join(rest, "uid", "left_semi"), most, -(-rest.count() // ITEMS), 2), "packed")
        placed = placed.unionByName(again.select("uid", number(1).alias("sequence_id"), "offset"))
    return cut.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
