"""Table functions, the fluent API, streams against batches, and edge cases of rewrites."""

from pyspark.sql import functions as F

from docloom.functions import marks
from docloom.operators import rewrite as rw
from docloom.plans.api import Documents, register
from docloom.streaming import documents as streams

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_table_functions_in_sql(spark):
    register(spark)
    spark.createDataFrame([(1, "# A\n\n[b](c \"d\")\n\n| x |\n|---|\n| y |\n"), (2, None), (3, "")], "id int, t string").createOrReplaceTempView("tf")
    rows = lambda f, c: [tuple(r) for r in spark.sql(f"SELECT id, {c} FROM tf, LATERAL {f}(t, 'gfm') ORDER BY ALL").collect()]
    assert rows("doc_blocks", "ord, tag") == [(1, 0, "Header"), (1, 1, "Para"), (1, 2, "Table")]
    assert rows("doc_links", "text, url, title") == [(1, "b", "c", "d")]
    assert rows("doc_cells", "section, text") == [(1, "body", "y"), (1, "head", "x")]


def test_fluent_documents(spark):
    docs = Documents.read(spark.createDataFrame([(1, "# A b"), (2, "c")], "doc_id int, content string"), "gfm")
    assert [(r.doc_id, r.text) for r in docs.headings().collect()] == [(1, "A b")]
    assert docs.render("html").where("doc_id = 2").first().output == "<p>c</p>\n"
    assert docs.errors().count() == 0 and docs.cells().count() == 0 and docs.nodes().count() == 6


def test_streamed_windows_and_copies_equal_the_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "events"))
    for name, make, mode in (("w", lambda e: streams.window_counts(e, "1 hour"), "complete"), ("s", lambda e: streams.window_counts(e, "2 hours", "1 hour"), "complete")):
        make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(batch).collect()))
    streams.write(streams.deduplicated(stream, ("event_id",), "400 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == streams.deduplicated(batch, ("event_id",)).count()


def test_streamed_files_are_converted(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("*x*")
    (tmp_path / "in" / "b.html").write_text("<p>y</p>")
    out = streams.convert_files(streams.file_stream(spark, str(tmp_path / "in")), "markdown", "html")
    streams.write(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.output for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["<p><em>x</em></p>\n"]


def test_rewrites_on_small_trees(spark):
    nodes = spark.createDataFrame([(1, 0, 9, "Div", None, 0), (1, 1, 3, "Main", None, 1), (1, 2, 2, "Str", "a", 2), (1, 4, 8, "Str", "b", 1), (2, 0, 0, "Str", "c", 0)], "doc_id int, pre int, post int, tag string, text string, depth int")
    assert sorted((r.doc_id, r.pre) for r in rw.inside_first(nodes, F.col("tag") == "Main").collect()) == [(1, 1), (1, 2), (2, 0)]
    assert [(r.doc_id, r.depth) for r in rw.too_deep(nodes, 2).collect()] == [(1, 3)]
    assert rw.first_divergence(nodes, nodes).count() == 0
    assert [tuple(r) for r in rw.first_divergence(nodes, nodes.where("pre < 4")).collect()] == [(1, 4)]
    inl = spark.createDataFrame([(1, i, t) for i, t in enumerate(["Str", "Space", "LineBreak", "Space", "Str", "Space", "Str"])], "doc_id int, pos int, tag string")
    assert [r.pos for r in rw.without_space_at_breaks(inl).orderBy("pos").collect()] == [0, 2, 4, 5, 6]


def test_marks(spark):
    row = spark.range(1).select(
        marks.percent(F.lit(0.125)).alias("p"), marks.tabs_expanded(F.lit("a\tbcde\tf")).alias("t"), marks.tabs_expanded(F.lit("")).alias("e"),
        marks.metadata_pair(F.lit("k")).alias("k"), marks.metadata_pair(F.lit("a:b=c")).alias("m"), marks.multiset_difference(F.array(*map(F.lit, "aab")), F.array(F.lit("a"))).alias("d"),
        marks.opens_with_metadata(F.lit("---\n\nx")).alias("o"),
    ).first()
    assert (row.p, row.t, row.e, tuple(row.k), tuple(row.m), row.d, row.o) == ("12.5%", "a   bcde    f", "", ("k", "true"), ("a", "b=c"), ["a", "b"], False)
