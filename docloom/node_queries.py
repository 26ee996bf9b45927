"""Queries that exercise rewrites, look-ups, marks and windows over whole tables; registered with those of queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import marks
from docloom.operators import relational as rel
from docloom.operators import rewrite as rw
from docloom.plans import documents as doc
from docloom.queries import _PLACE, _lines, query, table
from docloom.streaming import documents as streams

# ---- links and look-ups


@query("SELECT o_custkey AS doc_id, o_orderkey AS id FROM orders o WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderkey = o.o_orderkey AND x.o_orderstatus = 'F')")
def linked_anchors(spark, sf_dir):
    """Anchors that a link of their document points to."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    links = rows.where("o_orderstatus = 'F'").select("doc_id", F.concat(F.lit("#"), "id").alias("url"))
    return rw.linked_anchors(rows.select("doc_id", "id"), links).select("doc_id", F.col("id").cast("long").alias("id"))


@query("SELECT o_custkey AS doc_id, o_orderkey AS pre, CASE WHEN o_orderstatus = 'F' THEN '#s' || o_orderkey ELSE '#' || o_orderkey END AS url FROM orders")
def repointed_links(spark, sf_dir):
    """Internal links turned to the identifiers that their anchors got."""
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id")
    name = F.col("o_orderkey").cast("string")
    links = rows.select("doc_id", F.col("o_orderkey").alias("pre"), F.concat(F.lit("#"), name).alias("url"))
    anchors = rows.where("o_orderstatus = 'F'").select("doc_id", name.alias("name"), F.concat(F.lit("s"), name).alias("id"))
    return rw.repointed(links, anchors).select("doc_id", "pre", "url")


@query("""
SELECT d.doc_id, p_partkey, CASE (p_partkey + d.doc_id) % 2 WHEN 0 THEN 'decimal' ELSE 'bullet' END AS format,
  CASE WHEN n_nationkey % 5 = 0 THEN 100 + n_nationkey + d.doc_id ELSE p_partkey % 3 + 1 END::INT AS start
FROM part CROSS JOIN (SELECT unnest(range(2))::INT AS doc_id) d LEFT JOIN nation ON n_nationkey = p_partkey % 25
""")
def numbering_levels(spark, sf_dir):
    """Paragraphs of two documents that look up their numbering, its levels, and overrides of those, under the same keys."""
    part, nation, two = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation"), F.explode(F.array(F.lit(0), F.lit(1))).alias("doc_id")
    paragraphs = part.select(two, "p_partkey", (F.col("p_partkey") % 25).cast("int").alias("num"), (F.col("p_partkey") % 6).cast("int").alias("level"))
    nums = nation.select(two, F.col("n_nationkey").alias("num"), F.lit(1).alias("abstract"))
    levels = spark.range(6).select(two, F.lit(1).alias("abstract"), F.col("id").cast("int").alias("level"), (F.col("id") % 3 + 1).cast("int").alias("start"))
    levels = levels.withColumn("format", F.when((F.col("level") + F.col("doc_id")) % 2 == 0, "decimal").otherwise("bullet"))
    overrides = nation.where("n_nationkey % 5 = 0").select(two, F.col("n_nationkey").alias("num"), F.sequence(F.lit(0), F.lit(5)).alias("levels"))
    overrides = overrides.select("doc_id", "num", F.explode("levels").alias("level"), (F.col("num") + 100 + F.col("doc_id")).alias("start"))
    return rw.numbering_levels(paragraphs, nums, levels, overrides).select("doc_id", "p_partkey", "format", "start")


@query("SELECT o_custkey AS doc_id, o_orderkey AS pos, c_name || '.xhtml' AS href, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT - 1 AS place FROM orders JOIN customer ON c_custkey = o_custkey")
def reading_order(spark, sf_dir):
    """Spine items resolved in the manifest."""
    spine = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.lit("c").alias("idref"))
    manifest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("c").alias("id"), F.concat("c_name", F.lit(".xhtml")).alias("href"))
    return rw.reading_order(spine, manifest).select("doc_id", "pos", "href", "place")


@query("""
SELECT o_custkey AS doc_id, o_orderstatus AS key, CASE WHEN o_orderstatus = 'F' THEN max(o_orderkey)::VARCHAR ELSE string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) END AS joined FROM orders GROUP BY o_custkey, o_orderstatus
""")
def grouped_metadata(spark, sf_dir):
    """Repeated fields: of some the last one counts, others become lists."""
    fields = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("value"))
    return rw.grouped_metadata(fields, ("F",)).select("doc_id", "key", F.array_join("values", " ").alias("joined"))


# ---- tables and lists


# an order of a customer is a table (or list) of that document; its number restarts in each document
_TABLES = "(SELECT o_custkey AS doc_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS t, l.* FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"


def _tables(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey")
    return lines.withColumn("table", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("l_orderkey"))).withColumn("pre", F.expr(_PLACE))


@query(f'SELECT doc_id, t AS "table", max(n)::BIGINT AS columns FROM (SELECT doc_id, t, l_linenumber, sum(l_partkey % 3 + 1) AS n FROM {_TABLES} GROUP BY ALL) GROUP BY doc_id, t')
def column_counts(spark, sf_dir):
    return rw.column_counts(_tables(spark, sf_dir).select("doc_id", "table", F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 3 + 1).alias("col_span")))


@query(f"""SELECT doc_id, t AS "table", l_partkey % 3 AS col, l_quantity::DOUBLE / greatest(sum(l_quantity::DOUBLE) OVER (PARTITION BY doc_id, t), 1.0::DOUBLE) AS share, {_PLACE} AS pre FROM {_TABLES}""")
def column_shares(spark, sf_dir):
    columns = _tables(spark, sf_dir).select("doc_id", "table", "pre", (F.col("l_partkey") % 3).alias("col"), F.col("l_quantity").alias("width"))
    return rw.column_shares(columns).select("doc_id", "table", "col", "share", "pre")


@query(f'SELECT doc_id, t AS "table", l_partkey % 3 AS col, arg_min(l_returnflag, {_PLACE}) AS align FROM {_TABLES} GROUP BY doc_id, t, l_partkey % 3')
def column_alignments(spark, sf_dir):
    cells = _tables(spark, sf_dir).select("doc_id", "table", F.col("pre").alias("row"), (F.col("l_partkey") % 3).alias("col"), F.col("l_returnflag").alias("align"))
    return rw.column_alignments(cells)


@query(f"SELECT doc_id, t AS list, bool_or(l_returnflag = 'R') AS loose FROM {_TABLES} GROUP BY doc_id, t")
def loose_lists(spark, sf_dir):
    children = _tables(spark, sf_dir).select("doc_id", F.col("table").alias("list"), F.when(F.col("l_returnflag") == "R", "Para").otherwise("Plain").alias("tag"))
    return rw.loose_lists(children)


@query(f"""
WITH k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY t, {_PLACE}) AS pre, CASE l_partkey % 3 WHEN 0 THEN 'caption' WHEN 1 THEN 'table' ELSE 'text' END AS kind FROM {_TABLES}),
n AS (SELECT *, lag(kind) OVER w AS b, lag(pre) OVER w AS bp FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pre)),
r AS (SELECT *, sum((NOT coalesce((kind = 'caption' AND b = 'table') OR (kind = 'table' AND b = 'caption'), false))::INT) OVER (PARTITION BY doc_id ORDER BY pre) AS run FROM n WHERE kind <> 'text'),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pre) AS i FROM r)
SELECT x.doc_id, x.pre::INT AS pre, y.pre::INT AS caption FROM p x LEFT JOIN p y ON y.doc_id = x.doc_id AND y.run = x.run AND y.i = CASE WHEN x.i % 2 = 1 THEN x.i + 1 ELSE x.i - 1 END WHERE x.kind = 'table'
""")
def caption_pairs(spark, sf_dir):
    """Tables and the captions beside them, each taken once."""
    kind = F.element_at(F.array(F.lit("caption"), F.lit("table"), F.lit("text")), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = _tables(spark, sf_dir)
    return rel.caption_pairs(rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("table", "pre")).alias("pre"), kind.alias("kind")))


@query("""
SELECT l.o_custkey AS doc_id, l.o_orderkey AS pre, CASE WHEN n.o_orderkey IS NOT NULL THEN 'note ' || n.o_orderkey END AS body FROM orders l
LEFT JOIN orders n ON n.o_custkey = l.o_custkey AND n.o_orderstatus = 'F' AND n.o_orderkey = l.o_orderkey
""")
def noted_links(spark, sf_dir):
    """References resolved in the notes of their document; others stay links."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pre"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    notes = rows.where("o_orderstatus = 'F'").select("doc_id", "id", F.concat(F.lit("note "), "id").alias("body"))
    return rw.noted_links(rows.select("doc_id", "pre", F.concat(F.lit("#"), "id").alias("url")), notes).select("doc_id", "pre", "body")


@query(f"""
WITH i AS (SELECT l_orderkey AS doc_id, {_PLACE} AS pre, l_partkey % 2 AS num, l_suppkey % 3 AS level FROM lineitem),
g AS (SELECT *, CASE level WHEN 0 THEN 0 ELSE sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w END AS g1, CASE level WHEN 2 THEN sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w ELSE 0 END AS g2 FROM i WINDOW w AS (PARTITION BY doc_id, num ORDER BY pre))
SELECT doc_id, pre, row_number() OVER (PARTITION BY doc_id, num, level, g1, g2 ORDER BY pre)::INT AS number FROM g
""")
def item_numbers(spark, sf_dir):
    """Numbers of list items that go on over interruptions and start anew after lesser levels."""
    items = _lines(spark, sf_dir).withColumn("num", F.col("l_partkey") % 2).withColumn("level", F.col("l_suppkey") % 3)
    return rw.item_numbers(items).select("doc_id", "pre", "number")


@query(f"SELECT l_orderkey AS doc_id, {_PLACE} AS pre, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_PLACE})::INT AS number FROM lineitem")
def note_numbers(spark, sf_dir):
    return rw.note_numbers(_lines(spark, sf_dir)).select("doc_id", "pre", "number")


@query(f"""
WITH f AS (SELECT l_orderkey AS doc_id, {_PLACE} AS pre, min({_PLACE}) OVER (PARTITION BY l_orderkey, l_returnflag) AS first FROM lineitem)
SELECT doc_id, pre, 'T' || dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS style FROM f
""")
def style_registry(spark, sf_dir):
    """Generated names by a style's first use."""
    return rw.registered(_lines(spark, sf_dir), "l_returnflag", "T", "style").select("doc_id", "pre", "style")


# ---- trees and tokens


@query("SELECT page_id, regexp_extract(html, '<a href=\"([^\"]*)\"', 1) AS url FROM pages WHERE html LIKE '%<a href=\"%'")
def first_links(spark, sf_dir):
    nodes = doc.nodes(doc.Source(table(spark, sf_dir, "pages"), "html", "html", "page_id"), ("Link",), ("pre", "tag", "url"))
    return rw.first_matches(nodes, "Link", "url").select(F.col("doc_id").alias("page_id"), "url")


@query(r"SELECT doc_id, len(regexp_extract_all(trim(text, E' \t\r\n'), '[ \t\r\n]+|[^ \t\r\n]+'))::BIGINT AS n FROM documents WHERE trim(text, E' \t\r\n') <> ''")
def trimmed_tokens(spark, sf_dir):
    from docloom.functions.text import tokens

    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.concat(F.lit(" "), "text", F.lit("\n")))).alias("pos", "token"))
    return rw.trimmed(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, 1 AS pre FROM documents WHERE doc_id % 3 = 0")
def first_divergence(spark, sf_dir):
    """Trees of texts against those of the same texts, every third with a word put before it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Zzyx "), "text")).otherwise(F.col("text")))
    of = lambda df: doc.nodes(doc.Source(df, "commonmark", "text"), columns=("pre", "tag", "text", "depth"))
    return rw.first_divergence(of(docs), of(changed))


@query(f"""
WITH a AS (SELECT l_orderkey AS doc_id, l_returnflag AS x, count(*) FILTER (WHERE l_linestatus = 'F') AS m, count(*) FILTER (WHERE l_linestatus <> 'F') AS k FROM lineitem GROUP BY ALL)
SELECT doc_id, sum(least(m, k))::INT AS shared, sum(greatest(m - k, 0))::INT AS extra FROM a GROUP BY doc_id
""")
def modifier_multisets(spark, sf_dir):
    """What two runs' modifiers share and what only the first has, as multisets."""
    flags = lambda s, name: F.collect_list(F.when(s, F.col("l_returnflag"))).alias(name)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(flags(F.col("l_linestatus") == "F", "a"), flags(F.col("l_linestatus") != "F", "b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("doc_id", F.size(marks.multiset_intersection(a, b)).alias("shared"), F.size(marks.multiset_difference(a, b)).alias("extra"))


# ---- marks


@query("SELECT page_id, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS scheme, CASE page_id % 3 WHEN 0 THEN 'uri' WHEN 1 THEN 'email' END AS class FROM pages")
def url_classes(spark, sf_dir):
    text, url = F.col("url"), F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("mailto:"), "url")).otherwise(F.lit("x"))
    return table(spark, sf_dir, "pages").select("page_id", marks.has_scheme(text).alias("scheme"), marks.autolink_class(text, url).alias("class"))


@query("SELECT doc_id, doc_id % 2 = 0 AND regexp_matches(text, '^[ \\t]*[^\\s]') AS meta, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS task FROM documents")
def text_marks(spark, sf_dir):
    opened = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---\n"), "text")).otherwise(F.col("text"))
    item = F.concat(F.element_at(F.array(F.lit("☒"), F.lit("☐"), F.lit("-")), (F.col("doc_id") % 3 + 1).cast("int")), F.lit(" x"))
    return table(spark, sf_dir, "documents").select("doc_id", marks.opens_with_metadata(opened).alias("meta"), marks.task_state(item).alias("task"))


@query("SELECT p_partkey, p_size * 20 AS twips, p_size::BIGINT * 12700 AS emu, p_size || '%' AS percent, sha1(p_name) || '.png' AS name, 'k' AS key, p_name AS value FROM part")
def measures(spark, sf_dir):
    pt, pair = F.concat(F.col("p_size").cast("string"), F.lit("pt")), marks.metadata_pair(F.concat(F.lit("k="), "p_name"))
    share = marks.percent(F.col("p_size") / 100)
    return table(spark, sf_dir, "part").select(
        "p_partkey", marks.twips(pt).cast("int").alias("twips"), marks.emu(pt).alias("emu"), share.alias("percent"),
        marks.media_name(F.col("p_name").cast("binary"), F.lit("png")).alias("name"), pair["key"].alias("key"), pair["value"].alias("value"),
    )


@query("SELECT p_partkey, p_name || repeat(' ', (4 - length(p_name) % 4)::INT) || p_brand AS line FROM part")
def tabs_expanded(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", marks.tabs_expanded(F.concat("p_name", F.lit("\t"), "p_brand")).alias("line"))


@query("SELECT p_partkey, p_name || repeat(' ', (4 - length(p_name) % 4)::INT) || 'x' || chr(10) || '    ' || p_brand || chr(10) AS text FROM part")
def lines_prepared(spark, sf_dir):
    made = F.concat("p_name", F.lit("\tx\r\n\t"), "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", marks.lines_prepared(made).alias("text"))


@query("SELECT p_partkey, '<pre class=\"a\">' || chr(10) || chr(10) || p_name || '</pre><p>' || chr(10) || 'x</p><TextArea>' || chr(10) || chr(10) || '</TextArea>' AS html FROM part")
def pre_newlines(spark, sf_dir):
    made = F.concat(F.lit('<pre class="a">\n'), "p_name", F.lit("</pre><p>\nx</p><TextArea>\n</TextArea>"))
    return table(spark, sf_dir, "part").select("p_partkey", marks.leading_newlines_doubled(made).alias("html"))


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'word/media/a b' || p_partkey || '.png' WHEN 1 THEN 'media/i' || p_partkey WHEN 2 THEN 'x/' || p_partkey ELSE 'word/c' || p_partkey END AS path FROM part
""")
def resolved_paths(spark, sf_dir):
    """Relationship targets seen from a part of a package."""
    key = F.col("p_partkey").cast("string")
    target = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("media/a%20b"), key, F.lit(".png"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("../media/./i"), key))
    target = target.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("../../../x/"), key)).otherwise(F.concat(F.lit("/word/b/../c"), key))
    return table(spark, sf_dir, "part").select("p_partkey", marks.resolved_path(F.lit("word/document.xml"), target).alias("path"))


# ---- relations of documents, by Spark's own operators


@query("""
SELECT 'both' AS op, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'either', doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)
""")
def set_operations(spark, sf_dir):
    """Documents with and without labels."""
    docs, labels = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "doc_id")
    return named("both", docs.intersect(labels)).unionByName(named("unlabelled", docs.exceptAll(labels).distinct())).unionByName(named("either", docs.union(labels).distinct()))


@query("""
SELECT doc_id, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(10) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS decile,
  sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC)
""")
def ranked_documents(spark, sf_dir):
    """Documents of a source by length."""
    w, u = Window.partitionBy("source").orderBy(F.desc("n_chars")), Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(10).over(u).cast("long").alias("decile"), F.sum("n_chars").over(u.rowsBetween(-2, 0)).alias("recent"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_documents(spark, sf_dir):
    """A top-k report."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT event_id, year(ts)::INT AS year, dayofyear(ts)::INT AS day, date_trunc('week', ts)::TIMESTAMP AS week, strftime(ts, '%Y-%m-%dT%H:%M') AS minute FROM events")
def calendar_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.year("ts").alias("year"), F.dayofyear("ts").alias("day"), F.date_trunc("week", "ts").alias("week"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("minute"))


# ---- windows over events, the same functions as over streams


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return streams.window_counts(table(spark, sf_dir, "events"), "1 hour")


@query("""
WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM o)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM g GROUP BY user_id, s
""")
def event_sessions(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"), "30 minutes")
