"""Slices of Arrow batches by bytes, tables dealt over cores, and node operators on documents that reuse their keys."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import relational as rel
from docloom.operators import rewrite as rw
from docloom.plans import documents as doc
from docloom.plans.batches import ROW, byte_slices, spread


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.just("x" * 5000)), max_size=40), st.integers(20, 400))
def test_slices_hold_few_bytes_and_every_row(texts, most):
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    parts = [p.column(0).to_pylist() for p in byte_slices(batch, most)]
    assert [t for p in parts for t in p] == texts
    for p in parts:
        assert len(p) == 1 or sum(ROW + len((t or "").encode()) for t in p) <= most


def test_one_long_text_stands_alone():
    batch = pa.RecordBatch.from_pydict({"i": list(range(101)), "t": ["short"] * 50 + ["long" * 100_000] + ["short"] * 50})
    assert [p.num_rows for p in byte_slices(batch, 10_000)] == [50, 1, 50]


def test_small_inputs_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(100).repartition(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(spark.range(10)).count() == 10
    out = doc.parse(df.select(F.col("id").alias("doc_id"), F.lit("a *b*").alias("content")), "gfm")
    assert out.count() == 100


def test_documents_that_reuse_keys_stay_apart(spark):
    paragraphs = spark.createDataFrame([(1, 5, 0), (2, 5, 0)], "doc_id int, num int, level int")
    nums = spark.createDataFrame([(1, 5, 7), (2, 5, 8)], "doc_id int, num int, abstract int")
    levels = spark.createDataFrame([(1, 7, 0, "decimal", 1), (2, 8, 0, "bullet", 1), (2, 7, 0, "upperRoman", 9)], "doc_id int, abstract int, level int, format string, start int")
    overrides = spark.createDataFrame([(1, 5, 0, 4)], "doc_id int, num int, level int, start int")
    assert sorted((r.doc_id, r.format, r.start) for r in rw.numbering_levels(paragraphs, nums, levels, overrides).collect()) == [(1, "decimal", 4), (2, "bullet", 1)]
    cells = spark.createDataFrame([(1, 0, 0, 0, 1, 2, "a"), (1, 0, 0, 1, 1, 1, "bb"), (1, 0, 1, 0, 1, 1, "c"), (2, 0, 0, 0, 1, 1, "dddd")], "doc_id int, `table` int, row int, cell int, col_span int, row_span int, text string")
    assert sorted((r.doc_id, r.row, r.cell, r.grid_col, r.text) for r in rel.grid_columns(cells).collect()) == [(1, 0, 0, 0, "a"), (1, 0, 1, 1, "bb"), (1, 1, 0, 1, "c"), (2, 0, 0, 0, "dddd")]
    assert sorted((r.doc_id, r.columns) for r in rw.column_counts(cells).collect()) == [(1, 2), (2, 1)]
    assert sorted((r.doc_id, r.col, r.width) for r in rw.column_widths(cells.withColumnRenamed("cell", "col")).collect()) == [(1, 0, 1), (1, 1, 2), (2, 0, 4)]
    styles = spark.createDataFrame([(1, "a", "A", "b"), (1, "b", "B", None), (2, "b", "X", "a"), (2, "a", "Y", "b")], "doc_id int, id string, name string, based_on string")
    found = sorted((r.doc_id, r.id, r.hop, r.name) for r in rel.style_names(styles, 3).collect())
    assert found == [(1, "a", 0, "A"), (1, "a", 1, "B"), (1, "b", 0, "B"), (2, "a", 0, "Y"), (2, "a", 1, "X"), (2, "a", 2, "Y"), (2, "b", 0, "X"), (2, "b", 1, "Y"), (2, "b", 2, "X")]


def test_no_number_of_rows_ends_the_styles_chains(spark):
    based = {i: i - 1 if i % 10 else None for i in range(60)} | {70: 70, 71: 99}
    styles = spark.createDataFrame([(1, i, f"s{i}", b) for i, b in based.items()], "doc_id int, id int, name string, based_on int")
    spark.conf.set("spark.sql.cteRecursionRowLimit", 20)
    try:
        for hops in (1, 2, 5, 16):
            want, found = [], sorted((r.id, r.hop, r.name) for r in rel.style_names(styles, hops).collect())
            for i in based:
                at, hop = i, 0
                while at in based and hop < hops:
                    want.append((i, hop, f"s{at}"))
                    at, hop = based[at], hop + 1
            assert found == sorted(want)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_sections_down_to_level_nine(spark):
    heads = spark.createDataFrame([(1, 0, 1), (1, 1, 7), (1, 2, 8), (1, 3, 8), (1, 4, 2)], "doc_id int, pre int, level int")
    assert [r.number for r in rel.section_numbers(heads).orderBy("pre").collect()] == ["1", "1.0.0.0.0.0.1", "1.0.0.0.0.0.1.1", "1.0.0.0.0.0.1.2", "1.1"]


def test_captions_belong_to_one_neighbour(spark):
    kinds = ["caption", "table", "caption", "text", "table", "caption", "caption", "table", "image"]
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)] + [(2, 0, "table")], "doc_id int, pre int, kind string")
    found = {(r.doc_id, r.pre): r.caption for r in rel.caption_pairs(rows).collect()}
    assert found == {(1, 1): 0, (1, 4): 5, (1, 7): 6, (1, 8): None, (2, 0): None}
