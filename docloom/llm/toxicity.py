"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter, OrderedDict

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_map, stored

_WORD = re.compile(r"[^\W\d_]+")
BLOCK = 1024  # examples of a block
LEAST_TELLING = 0.02
_KEPT = 1 << 14


def features(text: str) -> Counter:
    """Counts of a text's words, which are runs of letters in lower case."""
    return Counter(_WORD.findall(text.lower()))


def numbers(terms) -> np.ndarray:
    """Terms as 64-bit hashes."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms)).view(np.int64)


def copy_group(text: str) -> int:
    """The least hash of a text's runs of five words: near copies mostly share it, other texts seldom do."""
    words = text.lower().split()
    return min((xxhash.xxh3_64_intdigest(" ".join(words[i : i + 5])) >> 1 for i in range(max(1, len(words) - 4))), default=0)


def telling(a: np.ndarray, b: np.ndarray, p: float, q: float) -> np.ndarray:
    """How well a term tells the labels apart: the root of its chi-square, over that of a term that tells all; at least
    LEAST_TELLING, so that every term counts. a of p texts of label 1 and b of q others hold it."""
    n, df = p + q, a + b
    chi = (a / p - b / q) ** 2 / (df / n * (1 / p + 1 / q) * np.maximum(1 - df / n, 1e-9))
    return np.maximum(np.sqrt(chi / n), LEAST_TELLING)


class BlockMaxIndex:
    """Examples as unit vectors of sublinear TF-IDF, by term in postings cut into blocks of BLOCK examples.

    bounds[t, b] is the largest weight of term t in block b, so a query's product with bounds limits the cosine of every
    example of a block. Blocks are scored in falling order of that limit until it is under the k-th best cosine; the
    result is the exact top k, ties to the smaller place.
    """

    def __init__(self, idf: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        """Example i has the terms terms[starts[i] : starts[i + 1]], places in idf, with their counts tfs."""
        self.idf, self.n = np.asarray(idf, np.float64), len(starts) - 1
        self.blocks = max(1, -(-self.n // BLOCK))
        owner = np.repeat(np.arange(self.n, dtype=np.int64), np.diff(starts))
        w = (1 + np.log(np.asarray(tfs, float))) * self.idf[terms]
        norm = np.sqrt(np.bincount(owner, weights=w * w, minlength=self.n))
        w = w / np.where(norm > 0, norm, 1)[owner]
        order = np.lexsort((owner, terms))
        at = np.asarray(terms, np.int64)[order] * self.blocks + owner[order] // BLOCK
        self.weights = w[order]
        self.places = (owner[order] % BLOCK).astype(np.int16)
        self.ends = np.r_[0, np.cumsum(np.bincount(at, minlength=len(self.idf) * self.blocks))].astype(np.int64)
        bounds = np.zeros(len(self.idf) * self.blocks, np.float32)
        if len(at):
            first = np.flatnonzero(np.r_[True, np.diff(at) != 0])
            # rounded up, so that a bound is never under its weights
            bounds[at[first]] = np.nextafter(np.maximum.reduceat(self.weights, first).astype(np.float32), np.float32(2))
        self.bounds = bounds.reshape(len(self.idf), self.blocks)

    def unit(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(np.asarray(tf, float))) * self.idf[terms]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm > 0 else w

    def cosines(self, block: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The cosines of a block's examples with a query."""
        cell = terms * self.blocks + block
        lo = self.ends[cell]
        n = self.ends[cell + 1] - lo
        some = np.flatnonzero(n)
        if not len(some):
            return np.zeros(BLOCK)
        lo, n, weights = lo[some], n[some], weights[some]
        ends = np.cumsum(n)
        rows = np.arange(ends[-1]) + np.repeat(lo - ends + n, n)
        return np.bincount(self.places[rows], weights=self.weights[rows] * np.repeat(weights, n), minlength=BLOCK)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, but: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(cosine, place) of the k nearest examples with a cosine over zero; those at `but` are left out."""
        if not len(terms):
            return []
        limits = weights @ self.bounds[terms]
        best_c, best_i = np.empty(0), np.empty(0, np.int64)
        for b in np.argsort(-limits, kind="stable"):
            if limits[b] <= 0 or len(best_c) == k and limits[b] < best_c[-1] - 1e-6:
                break
            found = np.round(self.cosines(int(b), terms, weights), 12)
            if but is not None:
                found[but[(but >= b * BLOCK) & (but < (b + 1) * BLOCK)] - b * BLOCK] = 0
            hit = np.flatnonzero(found >= best_c[-1] if len(best_c) == k else found > 0)
            best_c, best_i = np.concatenate([best_c, found[hit]]), np.concatenate([best_i, hit + b * BLOCK])
            first = np.lexsort((best_i, -best_c))[:k]
            best_c, best_i = best_c[first], best_i[first]
        return list(zip(best_c.tolist(), best_i.tolist()))


class Model:
    """Index, labels and calibration; see train()."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples: list[tuple], k: int, rate: float):
        """terms: sorted hashes, each with its weight in idf. examples: (id, label, weight, group, hashes, counts). rate: of label 1."""
        self.terms, self.k, self.rate = terms, k, rate
        known = [self.known(np.asarray(e[4], np.int64), np.asarray(e[5], np.int64)) for e in examples]
        # examples of one label and like numbers of terms stand together, so that blocks differ in their bounds
        order = sorted(range(len(examples)), key=lambda i: (-examples[i][1], len(known[i][0]), str(examples[i][0])))
        self.ids = [examples[i][0] for i in order]
        self.labels, self.weights = np.array([examples[i][1] for i in order], float), np.array([examples[i][2] for i in order], float)
        self.groups = np.array([examples[i][3] for i in order], np.int64)
        starts = np.r_[0, np.cumsum([len(known[i][0]) for i in order])].astype(np.int64)
        flat = lambda x: np.concatenate([known[i][x] for i in order]) if order else np.empty(0, np.int64)
        self.index = BlockMaxIndex(idf, starts, flat(0), flat(1))
        self.places: dict[int, list[int]] = {}
        for i, g in enumerate(self.groups.tolist()):
            self.places.setdefault(g, []).append(i)
        self.calibration, self.shared, self.kind = (1.0, 0.0), None, None
        self._reset()

    def _reset(self) -> None:
        self.kept: OrderedDict[tuple, tuple] = OrderedDict()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("kept", "shared")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def known(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the hashes that are terms of the index, by place."""
        if not len(self.terms) or not len(hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        there = self.terms[at] == hashes
        order = np.argsort(at[there], kind="stable")
        return at[there][order], counts[there][order]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, each weighing its own weight over (0.1 + cosine distance) squared, with
        a vote of weight 0.5 for the rate of label 1."""
        at = [i for _, i in near]
        w = self.weights[at] / (1.1 - np.minimum([c for c, _ in near], 1.0)) ** 2
        return float(((w * self.labels[at]).sum() + 0.5 * self.rate) / (w.sum() + 0.5))

    def left_out(self, hashes: np.ndarray, counts: np.ndarray, group: int) -> float:
        """The vote on an example by the examples outside its group of copies."""
        terms, counts = self.known(hashes, counts)
        return self.vote(self.index.top(terms, self.index.unit(terms, counts), self.k, but=np.array(self.places.get(group, []), np.int64)))

    def score(self, text: str | None, calibration: tuple[float, float] | None = None) -> tuple[float, list, list]:
        """Score, ids of the nearest examples, and the text's terms that weigh most in the cosine."""
        if not text:
            return self.rate, [], []
        key = len(text), xxhash.xxh3_128_intdigest(text)
        if (found := self.kept.get(key)) is None:
            found = self.kept[key] = self._score(text, calibration or self.calibration)
            if len(self.kept) > _KEPT:
                self.kept.popitem(last=False)
        return found

    def _score(self, text: str, calibration: tuple[float, float]) -> tuple[float, list, list]:
        found = features(text)
        names = list(found)
        hashes = numbers(names)
        terms, counts = self.known(hashes, np.fromiter(found.values(), np.int64, len(names)))
        weights = self.index.unit(terms, counts)
        near = self.index.top(terms, weights, self.k)
        if not near:
            return self.rate, [], []
        v = min(max(self.vote(near), 1e-4), 1 - 1e-4)
        value = 1 / (1 + np.exp(-(calibration[0] * np.log(v / (1 - v)) + calibration[1])))
        best = self.terms[terms[np.lexsort((terms, -weights))[:8]]].tolist()
        name_of = dict(zip(hashes.tolist(), names))
        return float(value), [self.ids[i] for _, i in near], [name_of[h] for h in best]


def platt(votes: list[float], labels: list[float], weights: list[float]) -> tuple[float, float]:
    """Slope and shift that turn the log odds of votes into those of label 1; (1, 0) where they would fall or one label is missing."""
    if len(set(labels)) < 2:
        return 1.0, 0.0
    v, y, m = np.clip(votes, 1e-4, 1 - 1e-4), np.array(labels, float), np.array(weights, float)
    x = np.log(v / (1 - v))
    n1, n0 = (m * y).sum(), (m * (1 - y)).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([(m * (p - goal) * x).sum() + 0.1 * (a - 1), (m * (p - goal)).sum()])
        h = m * p * (1 - p)
        h = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = 4000, fit_bytes: int = 48 << 20, k: int = 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from docs and labels (id, 0 or 1), which hold only rows that may be learned from.

    Labels that are null, or whose document is missing or null, are left out; of several labels of one id the larger
    counts, and rows that repeat an id are examples of their own. The fit uses a bounded sample of labelled rows, about
    fit_docs of them and fit_bytes of text, picked by a hash of the id, with whole texts; each is an example of the
    index. Terms are all words that stand in two examples or more. A term's weight is its inverse
    document frequency times how well it tells the labels apart (`telling`). Near copies are kept and share one
    example's weight, in the counts and in the votes. Without examples of both labels every text scores the rate of label 1.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marked = stored(marked, "toxic-labels")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = texts.select("id", F.octet_length("text").alias("size")).join(marked, "id").agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    share = min(1.0, fit_docs / max(1, size["n"]), fit_bytes / max(1, size["size"] or 0))
    picked = marked.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(2**31)) < int(share * 2**31)) if share < 1 else marked

    def counted(columns):
        found = [features(t) for t in columns[1]]
        return [columns[0], columns[2], [copy_group(t) for t in columns[1]], [numbers(list(f)) for f in found], [list(f.values()) for f in found]]

    kind = texts.schema["id"].dataType.simpleString()
    examples = stored(arrow_map(texts.join(picked, "id"), counted, f"id {kind}, y int, g long, terms array<long>, tfs array<int>"), "toxic-examples")
    weight = examples.groupBy("g").agg((1.0 / F.count("*")).alias("w"))
    examples = stored(examples.join(weight, "g"), "toxic-weighed")
    totals = examples.agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("y")).alias("p"), F.sum(F.col("w") * (1 - F.col("y"))).alias("q")).first()
    p, q = totals["p"] or 0.0, totals["q"] or 0.0
    rate = (p + 1) / (p + q + 2)
    if not p or not q:
        return Model(np.empty(0, np.int64), np.empty(0), [], k, rate)
    spread = examples.select("y", "w", F.explode("terms").alias("term"))
    known = spread.groupBy("term").agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("y")).alias("a"), F.sum(F.col("w") * (1 - F.col("y"))).alias("b")).where("n >= 2")
    # what reaches the driver is bounded by fit_docs and fit_bytes
    table = known.select("term", "a", "b").toArrow()
    term, a, b = (table.column(i).to_numpy() for i in range(3))
    order = np.argsort(term, kind="stable")
    term, a, b = term[order], a[order], b[order]
    idf = np.log(1 + (p + q) / (a + b)) * telling(a, b, p, q)
    rows = examples.select("id", "y", "w", "g", "terms", "tfs").toArrow()
    lists = lambda c: [x.values.to_numpy() for x in rows.column(c)]
    model = Model(term, idf, list(zip(rows.column("id").to_pylist(), rows.column("y").to_pylist(), rows.column("w").to_pylist(), rows.column("g").to_pylist(), lists("terms"), lists("tfs"))), k, rate)
    model.kind = kind
    model.shared = spark.sparkContext.broadcast(model)
    shared = model.shared
    votes = arrow_map(examples.select("terms", "tfs", "g", "y", "w"), lambda c: [[shared.value.left_out(np.asarray(t, np.int64), np.asarray(n, np.int64), g) for t, n, g in zip(*c[:3])], c[3], c[4]], "vote double, y int, w double").collect()
    model.calibration = platt([r["vote"] for r in votes], [r["y"] for r in votes], [r["w"] for r in votes])
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence_ids, evidence_terms) for every row.

    score estimates the chance of label 1; evidence are the nearest examples, nearest first, and the eight heaviest terms
    of the text that the index knows. A null or empty text, or one without such a term, scores the rate of label 1, with
    no evidence. Null ids and repeated rows stay, a row each; other columns aren't looked at. The index is bounded by
    train() and reaches the executors as a broadcast variable.
    """
    shared, calibration = model.shared or df.sparkSession.sparkContext.broadcast(model), model.calibration

    def rows(columns):
        found = [shared.value.score(t, calibration) for t in columns[1]]
        return [columns[0], [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    kind = df.schema[id_col].dataType.simpleString()
    of = model.kind or kind
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), rows, f"`{id_col}` {kind}, score double, evidence_ids array<{of}>, evidence_terms array<string>")
