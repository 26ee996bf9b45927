"""Where simhash.near_copies() finds all pairs that no anchor covers, and the exact Jaccard check of all its pairs."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_map, sample_below, stored
from docloom.llm.components import component_roots

SHINGLE, LEAST = 5, 0.8
FREQUENT, SAMPLE = 100_000, 10_000  # shingles known as frequent, from so many texts
_MUL = np.uint64(0x9E3779B97F4A7C15)
_PAIRS = 1 << 16
BINS, CHUNK = 64, 4096  # of a set's counts, four bits each; sets of a shingle that are compared in one group
FEW = 2  # a cell whose possible pairs are so many times its sets at most proposes them all at once


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's runs of `shingle` words, repeats included, or of all its words if there are fewer.

    A-Z are lower-cased; words are runs of other bytes than blanks and 0x09-0x0D, as in simhash.fingerprint().
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ one[i : i + n]) * _MUL
        h ^= h >> np.uint64(29)
    return h


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of words."""
    return np.unique(hashes(text, shingle).view(np.int64))


def missing(n: int, least: float) -> int:
    """How many of n shingles another set may lack and still reach the likeness `least`."""
    return n - math.ceil(n * least - 1e-9)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct arrays; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def prefix(found: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The first missing + 1 of a set's hashes, those that aren't in frequent first: two sets that reach `least` share
    one of them, whatever the order, as long as all sets have the same."""
    if not len(found):
        return found
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        found = found[np.argsort(frequent[at] == found, kind="stable")]
    return found[: missing(len(found), least) + 1]


def _groups(batches) -> Iterator[list[np.ndarray]]:
    """The batches' columns, cut where the first column changes: each list holds whole groups."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = [np.concatenate(x) for x in zip(held, now)] if held else now
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:].copy() for x in held]
    if held:
        yield held


def counts(found: np.ndarray) -> np.ndarray:
    """How many of a set's hashes fall into each of BINS bins, modulo 16, packed into four signed longs."""
    n = (np.bincount((found.view(np.uint64) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) & 15).astype(np.uint8)
    return (n[: BINS // 2] | n[BINS // 2 :] << 4).view(np.int64)


def _unpacked(longs: list[np.ndarray]) -> np.ndarray:
    """The bins of sets whose counts() are in columns, a row each."""
    both = np.ascontiguousarray(np.column_stack(longs)).view(np.uint8)
    return np.concatenate([both & 15, both >> 4], axis=1)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of members that only one of two sets has, by their bins; it never exceeds the true number."""
    d = (x - y) & 15
    return np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)


def sketch(found: np.ndarray) -> bytes:
    """A set's size, eight bytes, and the parities of its counts in bins, a bit each: the bins are the least power of two
    that is twice the size or more, 64 at least."""
    bins = max(64, 1 << (2 * len(found) - 1).bit_length())
    odd = np.bincount((found.view(np.uint64) & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return len(found).to_bytes(8, "little") + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def possible(x: bytes, y: bytes, least: float) -> bool:
    """Whether two sets can reach `least` by their sketches: in each bin of other parity one member or more is only in one
    set. Any two that do reach it are possible."""
    both = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    few, many = sorted((np.frombuffer(v, np.uint8, offset=8) for v in (x, y)), key=len)
    odd = few ^ np.bitwise_xor.reduce(many.reshape(-1, len(few)), axis=0)  # bins of the larger sketch fold onto the smaller's
    return int(np.bitwise_count(odd).sum(dtype=np.int64)) <= both * (1 - least) / (1 + least) + 1e-6


def _met(batches):
    """Of rows (token, pos, size, key), sorted by token: those whose token another set has too, with n, how many have it."""
    import pyarrow as pa

    for token, pos, size, key in _groups(batches):
        cuts = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
        n = np.repeat(np.diff(cuts), np.diff(cuts))
        keep = n > 1
        if keep.any():
            yield pa.RecordBatch.from_pydict({"token": token[keep], "pos": pos[keep], "size": size[keep], "key": key[keep], "n": n[keep].astype(np.int32)})


def _crossing(batches, least: float, every: bool):
    """Of rows (cell, part, size, pos, key, root, four counts), sorted by cell and size: the pairs (a, b) of sets of other
    roots in a cell that can be alike, and what is put off, as rows (a, b, cell, part, size, pos, key).

    A cell of few such pairs, or with `every` any cell, gives them all. Of a crowded one each set gives its nearest one by
    the counts, and all sets of the cell that have such a pair are put off: the next turn has them again. Roots only
    join, so no other set can be in a pair then. What is left out can't be alike, or not at this token: the sizes are too
    far apart, too few shingles follow the place where the sets meet (at their first common shingle enough do), or their
    counts are too far apart.
    """
    import pyarrow as pa

    def made(x, y, *off):
        kinds = {"cell": pa.int64(), "part": pa.int32(), "size": pa.int32(), "pos": pa.int32(), "key": pa.int64()}
        n, m = len(x), len(off[0]) if off else 0
        columns = {name: pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(m, pa.int64())]) for name, v in (("a", np.minimum(x, y)), ("b", np.maximum(x, y)))}
        columns |= {name: pa.concat_arrays([pa.nulls(n, kind), pa.array(v, kind)]) if off else pa.nulls(n, kind) for (name, kind), v in zip(kinds.items(), off or kinds)}
        return pa.RecordBatch.from_pydict(columns)

    share, spare = least / (1 + least), (1 - least) / (1 + least)  # of two sizes: what is common at least, and apart at most
    for cols in _groups(batches):
        cell, root = cols[0], cols[5]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        if not mixed.any():
            continue
        keep = np.repeat(mixed, np.diff(np.r_[starts, len(cell)]))
        cell, part, size, pos, key, root = (c[keep] for c in cols[:6])
        bins = _unpacked([c[keep] for c in cols[6:]])
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        lengths = np.diff(np.r_[starts, len(cell)])
        of = np.repeat(np.arange(len(starts)), lengths)  # a row's cell
        stop, few, n = (starts + lengths)[of], FEW * lengths, np.zeros(len(starts), np.int64)
        left = size - pos
        best, to = np.full(len(cell), 1 << 30), np.full(len(cell), -1)
        i, out, held = np.arange(len(cell)), [], 0
        for d in range(1, int(lengths.max())):
            i = i[i + d < stop[i]]
            i = i[size[i + d] * least <= size[i] + 1e-9]
            j = i + d
            both = size[i] + size[j]
            fits = np.flatnonzero((root[i] != root[j]) & ((part[i] == 0) | (part[i] != part[j])) & (np.minimum(left[i], left[j]) >= both * share - 1e-6))
            x, y = i[fits], j[fits]
            far = _apart(bins[x], bins[y])
            near = far <= both[fits] * spare + 1e-6
            x, y, far = x[near], y[near], far[near]
            if every:
                out.append((x, y))
                held += len(x)
                if held >= _PAIRS:
                    yield made(*(key[np.concatenate(v)] for v in zip(*out)))
                    out, held = [], 0
            else:
                np.add.at(n, of[x], 1)
                fit = n[of[x]] <= few[of[x]]
                out.append((x[fit], y[fit]))
                for one, other in ((x, y), (y, x)):
                    nearer = far < best[one]
                    best[one[nearer]], to[one[nearer]] = far[nearer], other[nearer]
        x, y = map(np.concatenate, zip(*out)) if out else (np.empty(0, np.int64),) * 2
        if every:
            if len(x):
                yield made(key[x], key[y])
            continue
        crowded = n > few
        open_cell = ~crowded[of[x]]
        off = np.flatnonzero((to >= 0) & crowded[of])
        x, y = np.r_[x[open_cell], off], np.r_[y[open_cell], to[off]]
        if len(x):
            yield made(key[x], key[y], cell[off], part[off], size[off], pos[off], key[off])


def _compared(batches, alike: Callable[[bytes, bytes], bool]):
    """Of rows (a, b, found), sorted by a and b, two of each pair: the pairs (a, b) whose two are alike."""
    import pyarrow as pa

    now, first = None, b""
    for batch in batches:
        good = []
        for a, b, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if now != (a, b):
                now, first = (a, b), found.as_py()
            elif alike(first, found.as_py()):
                good.append(now)
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in good], pa.int64()), "b": pa.array([b for _, b in good], pa.int64())})


def groups(docs: DataFrame, mark: Callable[[np.ndarray], int], near_marks: Callable[[DataFrame], DataFrame], least: float = LEAST, shingle: int = SHINGLE, turns: int = 3, key_col: str = "key", text_col: str = "text") -> DataFrame:
    """(key, root) for every row of docs, whose keys are distinct longs: links join texts whose sets of word shingles have
    a Jaccard similarity of `least` or more, and root is one key of all that links lead to. Each link is compared by 32-bit hashes of the shingles.

    mark makes a fingerprint of a text's shingle hashes, and near_marks finds the pairs (a, b) of close ones in a table
    of distinct marks (mark): the first candidates. Sets that reach `least` share one of the first missing + 1 shingles
    of any common order (rarer ones stand first, by a sample), so they meet there, and each is compared with every set
    there that is of another root and can be alike. Only where such pairs are crowded are they put off: in up to
    turns - 1 turns each set is compared with its nearest one there, which joins large groups by few comparisons, and in
    the last turn with all that are still of another root. So all links count: none is missed but those inside a group
    that others have joined. Sketches spare most pairs that aren't alike the comparison of their sets, and a pair's two
    meet in a group of their own. Equal sets are compared once. Texts without a word are alike.
    """
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text"))

    def sampled(batches):
        import pyarrow as pa

        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"s": shingles(text, shingle)})

    sample = sample_below(texts, "key", SAMPLE, texts.count())
    counted = sample.select("text").mapInArrow(sampled, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 2")
    frequent = np.array(sorted(r["s"] for r in counted.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").collect()), np.int64)
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def printed(columns):
        every = [hashes(t, shingle) for t in columns[1]]
        found = [np.unique(h.view(np.int64)) for h in every]
        return [columns[0], [xxhash.xxh3_128_digest(f.tobytes()) for f in found], [len(f) for f in found], [prefix(f, known.value, least) for f in found], [mark(h) for h in every], [sketch(f) for f in found], *np.array([counts(f) for f in found], np.int64).reshape(-1, 4).T]

    bins = ["c0", "c1", "c2", "c3"]
    prints = stored(arrow_map(texts, printed, "key long, digest binary, size int, first array<long>, mark long, sketch binary, " + ", ".join(f"{c} long" for c in bins)), "jaccard-prints")
    classes = stored(prints.groupBy("digest").agg(F.min("key").alias("own"), *[F.first(c).alias(c) for c in ("mark", "size", *bins)]), "jaccard-classes")
    chosen = prints.join(classes.select(F.col("own").alias("key")), "key", "left_semi")
    tokens = chosen.select(F.posexplode("first").alias("pos", "token"), "size", "key").select("token", "pos", "size", "key")
    met = stored(tokens.repartition("token").sortWithinPartitions("token").mapInArrow(_met, "token long, pos int, size int, key long, n int"), "jaccard-met")

    tried: list[DataFrame] = []

    def compared(pairs, made, alike):
        """The pairs (a, b) whose two are alike; made adds a key's `found` to rows (key, pairs)."""
        sides = pairs.select(F.explode(F.array("a", "b")).alias("key"), F.struct("a", "b").alias("pair"))
        at = stored(sides.groupBy("key").agg(F.collect_list("pair").alias("pairs")), "jaccard-sides")
        dealt = made(at).select(F.explode("pairs").alias("pair"), "found").select("pair.a", "pair.b", "found")
        return dealt.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(lambda x: _compared(x, alike), "a long, b long")

    def verified(pairs):
        """The pairs of keys (a, b) that are alike; those of earlier turns aren't compared again."""
        pairs = pairs.distinct()
        for seen in tried:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = stored(pairs, "jaccard-pairs")
        tried.append(pairs)
        can = stored(compared(pairs, lambda at: prints.select("key", F.col("sketch").alias("found")).join(at, "key"), lambda x, y: possible(x, y, least)), "jaccard-possible")
        # sets are made from the texts where they are read
        made = lambda at: arrow_map(texts.join(at, "key"), lambda c: [c[2], [np.unique((hashes(t, shingle) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in c[1]]], "pairs array<struct<a:long,b:long>>, found binary")
        return stored(compared(can, made, lambda x, y: similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least - 1e-9), "jaccard-links")

    # a shingle of more than CHUNK sets is dealt to several cells
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = met.select("*", F.pmod(F.xxhash64("key"), chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    cell = F.xxhash64("token", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("cell")
    part = F.signum(F.col("chunk") - F.col("other")).cast("int").alias("part")  # 0: all pairs of the cell
    kind = "a long, b long, cell long, part int, size int, pos int, key long"

    def crossing(rows, roots, every):
        """_crossing() of the rows (cell, part, size, pos, key) by their roots."""
        sets = classes.select(F.col("own").alias("key"), *bins).join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), *bins)
        rows = rows.join(sets, "key").select("cell", "part", "size", "pos", "key", "root", *bins)
        return rows.repartition("cell").sortWithinPartitions("cell", "size").mapInArrow(lambda x: _crossing(x, least, every), kind)

    rooted = lambda links: component_roots(links, "a", "b").withColumnRenamed("node", "key")
    joined = lambda roots, more: roots.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = rooted(verified(_by_marks(classes, near_marks, least)))
    rows, last = dealt.select(cell, part, "size", "pos", "key"), max(turns, 1)
    for turn in range(1, last + 1):
        found = stored(crossing(rows, roots, every=turn == last), "jaccard-crossing")
        roots = rooted(joined(roots, verified(found.where("a is not null").select("a", "b"))))
        rows = found.where("cell is not null").select("cell", "part", "size", "pos", "key")
        if rows.isEmpty():
            break
    roots = roots.withColumnRenamed("key", "node")
    of = classes.join(roots.select(F.col("node").alias("own"), "root"), "own", "left").select("digest", F.coalesce("root", "own").alias("root"))
    return prints.select("key", "digest").join(of, "digest").select("key", "root")


def _by_marks(classes: DataFrame, near_marks: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """Pairs of keys (a, b) whose marks are equal or close and whose sizes allow the likeness `least`.

    Sets of one mark are paired with the one of the least key among them, and close marks by those.
    """
    reps = stored(classes.groupBy("mark").agg(F.min(F.struct("own", "size")).alias("rep")), "jaccard-marks")
    same = classes.join(reps, "mark").where("own <> rep.own").select(F.col("rep.own").alias("a"), F.col("rep.size").alias("sa"), F.col("own").alias("b"), F.col("size").alias("sb"))
    side = lambda n: reps.select(F.col("mark").alias(n), F.col("rep.own").alias(f"own_{n}"), F.col("rep.size").alias(f"size_{n}"))
    pairs = near_marks(reps.select("mark")).join(side("a"), "a").join(side("b"), "b")
    close = pairs.select(F.col("own_a").alias("a"), F.col("size_a").alias("sa"), F.col("own_b").alias("b"), F.col("size_b").alias("sb"))
    both = same.unionByName(close).where((F.col("sa") >= least * F.col("sb") - 1e-9) & (F.col("sb") >= least * F.col("sa") - 1e-9))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
