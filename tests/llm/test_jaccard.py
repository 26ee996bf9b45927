"""The exact join of shingle sets, and the pipeline's stage on near copies that fingerprints miss."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as cp
from docloom.llm import jaccard, simhash


def edited(rng, words, n):
    """words with n of them replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.random()}"
    return out


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def brute(texts):
    """The root of every text: the least place that pairs of likeness 0.8 lead to."""
    sets, root = [plain(t) for t in texts], list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and like(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def some_texts():
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \t", "one two", "One two", "one two three", "a b c d e", "a b c d e f"]
    for base in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([9, 40, 150, 600]))]
        texts += [" ".join(words), " ".join(words + passage), " ".join(passage * 3 + words[:5])]
        texts += [" ".join(edited(rng, words, max(1, round(len(words) * part)))) for part in (0.005, 0.01, 0.02, 0.022, 0.025, 0.03, 0.05)]
        texts += [" ".join(words[: round(len(words) * part)]) for part in (0.7, 0.8, 0.81, 0.9)]
    return texts


def same_groups(found, root):
    return len(set(zip(found, root))) == len(set(found)) == len(set(root))


def test_groups_against_all_pairs(spark, monkeypatch):
    texts = some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    want = brute(texts)
    for frequent in (jaccard.FREQUENT, 0):
        monkeypatch.setattr(jaccard, "FREQUENT", frequent)
        found = {r.key: r.root for r in simhash.near_copies(docs).collect()}
        assert same_groups([found[i] for i in range(len(texts))], want)
    assert 40 < len(set(want)) < len(want)


def test_stage_drops_near_copies_that_fingerprints_miss(spark):
    rng = random.Random(1)
    rows = []
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        n = [2, 4, 5, 6, 20][base % 5]
        rows += [(2 * base, " ".join(words), "en", "a", 1), (2 * base + 1, " ".join(edited(rng, words, n)), "en", "a", 1)]
    sets = [plain(r[1]) for r in rows]
    want = {i for i in range(80) if i % 2 == 0 or like(sets[i], sets[i - 1]) < 0.8}
    assert 40 < len(want) < 80
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()} == want


def test_pairs_are_spared_only_if_they_cannot_be_alike():
    rng, spared = random.Random(3), 0
    some = lambda n: np.array([rng.getrandbits(64) for _ in range(n)], np.uint64).view(np.int64)
    for size in (1, 5, 40, 700, 5000):
        for part in (0, 0.05, 0.11, 0.2, 0.4):
            one = some(size)
            two = np.r_[one[round(size * part) :], some(round(size * part * rng.choice([0.1, 1])))]
            one, two = np.unique(one), np.unique(two)
            ok = jaccard.possible(jaccard.sketch(one), jaccard.sketch(two), 0.8)
            assert ok or jaccard.similarity(one, two) < 0.8
            spared += not ok
    assert spared >= 3


def test_cells_put_off_lose_no_pair(monkeypatch):
    n = 40
    cols = [np.repeat(np.arange(4), n // 4), np.zeros(n, np.int32), np.full(n, 100, np.int32), np.zeros(n, np.int32), np.arange(n), np.arange(n), *np.zeros((4, n), np.int64)]
    batch = lambda at: pa.RecordBatch.from_arrays([pa.array(c[at]) for c in cols], names=[str(i) for i in range(len(cols))])
    for few, put_off in ((0, n), (n, 0)):
        monkeypatch.setattr(jaccard, "FEW", few)
        first = [r for b in jaccard._crossing([batch(np.arange(n))], 0.8, False) for r in b.to_pylist()]
        off = [r["key"] for r in first if r["cell"] is not None]
        last = [r for b in jaccard._crossing([batch(np.array(off, int))], 0.8, True) for r in b.to_pylist()]
        assert len(off) == put_off
        assert {(r["a"], r["b"]) for r in first + last if r["a"] is not None} == {(i, j) for j in range(n) for i in range(j) if i // 10 == j // 10}
