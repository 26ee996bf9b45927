"""Mixing sources to target weights: repetition rates, whole copies and one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import WORD_CLASS, stored

WEIGHTS = (5, 2, 1)  # by the source's place in code-point order, repeating
SHARE, CEILING, SEED = 1.5, 2.0, "mix-1"
LONG = 10_000  # a document is long if it holds over 1 / LONG of its source's words


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def _uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def drawn(seed: str) -> Column:
    """u, a row's draw: uniform in [0, 1) by the hash of doc_id and seed."""
    return _uniform(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(seed))).alias("u")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """per_source (source, source_size) with a target for each: its part by weight of share times all sizes, at most
    ceiling times its size, the excess reshared by weight among those under it until none is above.

    This is water filling: ordered by size over weight, the first sources are at their ceiling and the rest share what
    is left. Its windows see one row per source, after aggregation.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = ceiling * F.col("source_size")
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = per_source.withColumn("weight", weight).withColumn("cap", cap).withColumn("level", level)
    full = F.col("cap") <= F.col("weight") * F.col("level")
    # levels fall along the order once a source is open, so the first open source has the greatest
    open_level = F.max(F.when(~full, F.col("level"))).over(Window.partitionBy())
    return ranked.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * open_level)).select("source", "source_size", "target")


def rates(sizes: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, rate) from rows of source and size, stored; a source without words has rate 0.

    A row per source: Spark broadcasts it only if its stored size is under the threshold, else it joins by a shuffle
    whose hot sources adaptive execution splits.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return stored(targets(per_source, **how).withColumn("rate", rate).coalesce(1), "mix-rates")


def spaced_draws(sizes: DataFrame, rated: DataFrame, seed: str) -> DataFrame:
    """(of, of_size, of_u, draw) for the long documents: those that hold over 1 / LONG of their source's words.

    Independent draws of a few long documents would miss the target by their weight. Ordered by size, they are drawn at
    even spaces instead: the document at place r takes its extra copy if a multiple of 1 lies in the r-th step of
    length `fraction` after a start that the hash of source and seed sets, uniform in [0, 1). Each document's
    probability is the fraction, whatever its place, and what neighbours of like size take comes near the fraction.
    A source has at most LONG such documents, so a window by source is bounded.
    """
    start = _uniform(F.concat_ws(":", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.lit(seed)))
    both = sizes.join(rated.select(F.col("source").alias("of"), "source_size", "rate"), F.col("source").eqNullSafe(F.col("of")))
    long = both.where(F.col("size") * LONG > F.col("source_size")).select("source", "size", "u", "rate").distinct()
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("size"), "u"))
    at = start + place * (F.col("rate") - F.floor("rate"))
    return stored(long.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("u").alias("of_u"), (at - F.floor(at)).alias("draw")), "mix-draws")


def _with_copies(rows: DataFrame, rated: DataFrame, draws: DataFrame) -> DataFrame:
    """rows (source, size, u, ...) with source_size, target, rate and copies: floor(rate) and one more if the row's draw is under the fraction."""
    found = rows.join(rated.withColumnRenamed("source", "by"), F.col("source").eqNullSafe(F.col("by")), "left")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")) & (F.col("u") == F.col("of_u"))
    extra = F.coalesce("draw", "u") < F.col("rate") - F.floor("rate")
    return found.join(draws, same, "left").withColumn("copies", (F.floor("rate") + extra.cast("long")).cast("long"))


def copy_counts(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies) for every row of docs.

    copies is floor(rate), and one more with the probability of the rest: by the row's own draw, or for long documents
    by spaced_draws(). Null texts have size 0. Null sources are one source, the last. Null ids are drawn as the text
    "null". Rows of one id, source and size share their draw, and each of them stays. An empty table gives an empty
    result; other columns aren't looked at.
    """
    sizes = stored(docs.select("doc_id", "source", words(F.col("text")).alias("size"), drawn(seed)), "mix-sizes")
    rated = rates(sizes, **how)
    return _with_copies(sizes, rated, spaced_draws(sizes, rated, seed)).select("doc_id", "source", "size", "source_size", "target", "rate", "copies")


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """docs with each row as often as the mix takes it; columns and edge cases as in copy_counts()."""
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("source"), words(F.col("text")).alias("size"), drawn(seed))
    sizes = stored(rows.select("source", "size", "u"), "mix-sizes")
    rated = rates(sizes, **how)
    found = _with_copies(rows, rated, spaced_draws(sizes, rated, seed)).where("copies > 0")
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
