"""The pipeline's stages on a small table, each against what its input asks for."""

import corpus_pipeline as cp
from docloom.llm import secrets


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def like(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


KIND = "doc_id long, text string, lang string, source string, n_chars long, extra int, row string, copies string, lang_pred string"


def small(spark):
    rows = []
    for i in range(60):
        lang, words = [("en", "the house of stone and the river"), ("fr", "la maison de pierre et la rivière")][i % 2]
        text = f"{words} " * 3 + f"number{i} street{i * 7} garden{i * 3} " * 8
        rows.append((i, text, lang, "ab"[i % 2], len(text)))
    rows += [(100, rows[0][1], "en", "a", 5), (101, None, None, None, None), (102, "123 456", "en", "a", 7), (103, rows[2][1] + " token=deadbeefdeadbeefdeadbeef00", None, "b", None), (0, rows[0][1], "en", "a", 5)]
    rows += [(104, "the house of stone and the river stands " * 20_000, "en", None, 1), (None, "the river of the house " * 9, "en", "a", 1)]
    return rows, spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], KIND)


def test_stages_in_turn(spark, tmp_path):
    rows, docs = small(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = cp.language(spark, docs, "").cache()
    assert kept.columns == list(cp.COLUMNS)
    ids = [r.doc_id for r in kept.collect()]
    assert 101 not in ids and 102 not in ids and len(ids) == len(rows) - 2
    assert kept.where("lang is null").count() == 0
    unique = cp.near_duplicates(spark, kept, "").cache()
    texts = {r.doc_id: r.text for r in kept.collect()}
    sets = {i: plain(t) for i, t in texts.items()}
    survivors = sorted(r.doc_id if r.doc_id is not None else -1 for r in unique.collect())
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if like(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                old, new = root[a], root[b]
                root = {i: new if r == old else r for i, r in root.items()}
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, 10**9), 10**9 if i is None else i)
    assert survivors == sorted(-1 if i == 10**9 else i for i in least.values())
    clean = cp.secret_scan(spark, unique, "").cache()
    assert clean.count() == unique.count()
    assert all(not secrets.base_spans(r.text) for r in clean.collect())
    mixed = cp.mixture(spark, clean, "").cache()
    assert mixed.columns == list(cp.COLUMNS) and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    packed = cp.sequences(spark, mixed, "")
    assert packed.where("piece = 0").count() == mixed.count()
    assert cp.run(spark, str(tmp_path)).where("piece = 0").count() == mixed.count()


def test_empty_table(spark):
    docs = spark.createDataFrame([], KIND)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
