"""SimHash near-duplicates by anchor points: fingerprints meet at the words of a covering code."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import jaccard
from docloom.llm.common import arrow_map, stored
from docloom.llm.components import component_roots

BITS, SHINGLE, SEED = 64, 3, 42
CHUNK = 4096  # fingerprints of an anchor that are compared at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text: bit i is set if it is set in over half of the shingles' XXH64 hashes.

    A-Z are lower-cased; words are runs of other bytes than blanks and 0x09-0x0D; a shingle is `shingle` words joined by
    blanks, the whole sequence if there are fewer. Without a word the fingerprint is 0.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    stops = ends[shingle - 1 :].tolist()
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The signed 64 bits that are set in over half of the hashes; 0 of none."""
    counts, n, hashes = np.zeros(BITS, np.int64), len(hashes), hashes.view(np.uint64)
    for at in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


# The [31, 26] Hamming code is perfect with radius 1: a word's syndrome (the XOR of its set bits' places, from 1) is 0 for
# code words, else the place of the one bit to flip.
_PLACES = np.arange(1, 32, dtype=np.uint32)
_FLIPS = (np.uint32(1) << (_PLACES - np.uint32(1))).astype(np.uint32)


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint32)
    for place, flip in zip(_PLACES, _FLIPS):
        out ^= np.where(words & flip, place, np.uint32(0)).astype(np.uint32)
    return out


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit words: (home, others). Anchors are the code words of the code over the low 31 bits, once with the top
    bit clear and once set, so each word is within 1 of its home. others holds all further anchors within 1 + 1 of it:
    16 columns.

    If two words differ in one bit at most, the second has the first's home among its home and others.
    """
    low, top = halves & np.uint32(0x7FFFFFFF), halves & np.uint32(0x80000000)
    s = _syndromes(low)
    flip = np.where(s > 0, np.left_shift(np.uint32(1), np.where(s > 0, s - 1, 0).astype(np.uint32)), np.uint32(0)).astype(np.uint32)
    home = (low ^ flip) | top
    # Code words at distance 2 flip places a < b with a ^ b = s; for a code word itself there is none.
    others = np.empty((len(halves), 16), np.uint32)
    pairs = [sorted((a, a ^ x) for a in range(1, 32) if a < a ^ x) for x in range(32)]
    table = np.array([[(1 << (a - 1)) | (1 << (b - 1)) for a, b in p] if x else [0] * 15 for x, p in enumerate(pairs)], np.uint32)
    others[:, :15] = (low[:, None] ^ table[s]) | top[:, None]
    others[:, 15] = home ^ np.uint32(0x80000000)
    return home, others


def replicated(prints: DataFrame) -> DataFrame:
    """(anchor, fp, host) per distinct fingerprint and anchor within covering radius and threshold.

    Two fingerprints within 3 bits differ in at most one bit in one of their 32-bit halves, so the code covers halves
    with threshold 1: an anchor is a half's number and a code word. Of the two, the first is host at its home anchor.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1 << 14):
                part = fp[at : at + (1 << 14)]
                if not len(part):
                    continue
                words = part.view(np.uint64)
                for half in (0, 1):
                    home, others = anchors(((words >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                    code = np.column_stack([home, others]).astype(np.int64) | (half << 32)
                    # a code word's own pairs are itself: such columns repeat the home
                    keep = np.column_stack([np.ones(len(part), bool), others != home[:, None]])
                    own = np.zeros(code.shape, bool)
                    own[:, 0] = True
                    yield pa.RecordBatch.from_pydict({"anchor": code[keep], "fp": np.broadcast_to(part[:, None], code.shape)[keep], "host": own[keep]})

    return prints.select("fp").mapInArrow(run, "anchor long, fp long, host boolean")


def _forest(fps: np.ndarray, hosts: np.ndarray, distance: int, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what lies within distance among fps (or between fps and others), a forest's worth at most.

    A pair counts if its first is a host. Each host is compared with the rest in one array; no pair list is kept.
    """
    second, shift = (fps, 0) if others is None else (others, len(fps))
    seen, label, out = second.view(np.uint64), np.arange(shift + len(second)), []
    for i in np.flatnonzero(hosts):
        near = np.flatnonzero(np.bitwise_count(seen ^ fps[i : i + 1].view(np.uint64)) <= distance)
        near = near[label[near + shift] != label[i]]
        while len(near):
            out.append((int(fps[i]), int(second[near[0]])))
            label[label == label[near[0] + shift]] = label[i]
            near = near[label[near + shift] != label[i]]
    return out


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b) fingerprints within distance whose links join the same classes as all such pairs do.

    Fingerprints (distinct) are dealt by anchor and each anchor's are compared where they meet, as host against all.
    An anchor's first CHUNK fingerprints are compared at once; one with more, which near copies can make, is put off:
    its chunks are compared pair by pair, each pair of chunks in a group of its own, so no task's memory grows with an anchor.
    """
    import pyarrow as pa

    kind = "a long, b long, anchor long, chunk int, host boolean"

    def compared(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        anchor_now, chunk = None, 0

        def rows(a, b, anchor=None, chunk=None, host=None):
            n = len(a)
            host = host if host is not None else [None] * n
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "anchor": pa.array([anchor] * n, pa.int64()), "chunk": pa.array([chunk] * n, pa.int32()), "host": pa.array(host, pa.bool_())})

        def taken():
            fps, hosts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            return fps, hosts

        def close():
            """Ends the anchor at hand: compares what is held, or passes on the last chunk of one that was put off."""
            if held:
                fps, hosts = taken()
                if chunk:
                    yield rows(fps, fps, anchor_now, chunk, hosts)
                elif len(fps) > 1 and hosts.any() and (found := _forest(fps, hosts, distance)):
                    yield rows(*zip(*found))

        for batch in batches:
            anchor, fp, host = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(anchor):
                continue
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            starts, stops = np.r_[0, cuts], np.r_[cuts, len(anchor)]
            # inside a batch, what is alone at its anchor has nothing to meet
            open_ended = (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
            for i in np.flatnonzero((stops - starts > 1) | open_ended):
                if anchor[starts[i]] != anchor_now:
                    yield from close()
                    anchor_now, chunk = int(anchor[starts[i]]), 0
                for at in range(starts[i], stops[i], CHUNK):
                    part = slice(at, min(stops[i], at + CHUNK))
                    if sum(len(h[0]) for h in held) + part.stop - part.start > CHUNK:
                        fps, hosts = taken()
                        yield rows(fps, fps, anchor_now, chunk, hosts)
                        chunk += 1
                    held.append((fp[part].copy(), host[part].astype(bool)))
        yield from close()

    dealt = replicated(prints).repartition("anchor").sortWithinPartitions("anchor")
    first = stored(dealt.mapInArrow(compared, kind), "simhash-links")
    near = first.where("chunk is null").select("a", "b")
    off = first.where("chunk is not null").select("anchor", "chunk", F.col("a").alias("fp"), "host")
    chunks = off.groupBy("anchor").agg((F.max("chunk") + 1).alias("chunks"))
    if chunks.isEmpty():
        return near
    spread = off.join(chunks, "anchor").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = spread.select("anchor", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), "chunk", "fp", "host")

    def cell(pdf):
        import pandas as pd

        x, y = pdf.x.iloc[0], pdf.y.iloc[0]
        one = pdf[pdf.chunk == x]
        if x == y:
            found = _forest(one.fp.to_numpy(np.int64), one.host.to_numpy(bool), distance)
        else:
            two = pdf[pdf.chunk == y]
            p, q = one.fp.to_numpy(np.int64), two.fp.to_numpy(np.int64)
            found = _forest(p, one.host.to_numpy(bool), distance, q) + _forest(q, two.host.to_numpy(bool), distance, p)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return near.unionByName(pairs.groupBy("anchor", "x", "y").applyInPandas(cell, "a long, b long"))


def near_duplicates(docs: DataFrame, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row: texts whose fingerprints differ in `distance` (0 to 3) bits or fewer are
    linked, and component_id is the least id that links lead to, the row's own included.

    Null and empty texts have fingerprint 0 and are linked like others. Null ids are no component's id unless it has no
    other. Repeated rows stay, a row each. Equal fingerprints are compared once. An empty table gives an empty result.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the covering code serves distances up to 3")
    kind = docs.schema[id_col].dataType.simpleString()
    prints = stored(arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), lambda c: [c[0], [fingerprint(t) for t in c[1]]], f"id {kind}, fp long"), "simhash-prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    roots = component_roots(links(distinct, distance), "a", "b")
    # fingerprints without a link are their own class
    classes = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(classes.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def near_copies(docs: DataFrame, least: float = jaccard.LEAST, shingle: int = jaccard.SHINGLE, distance: int = 3, key_col: str = "key", text_col: str = "text") -> DataFrame:
    """(key, root) for every row of docs, whose keys are distinct longs: texts whose runs of `shingle` words have a Jaccard
    similarity of `least` or more are linked, and root is one key of all that links lead to.

    Fingerprints of those runs that meet at an anchor within `distance` bits are the first candidates. At 0.8 most alike
    pairs differ in more bits than a covering code can serve, so texts also meet at their rarest runs, where every
    pair that can be alike is proposed; jaccard.groups() says how. Each pair is then compared. Null and empty texts are
    alike; repeated texts are compared once; an empty table gives an empty result.
    """
    near = lambda marks: links(marks.withColumnRenamed("mark", "fp"), distance)
    return jaccard.groups(docs, majority, near, least, shingle, key_col=key_col, text_col=text_col)
