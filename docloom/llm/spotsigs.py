"""Document fingerprints by spot signatures: chains of content words that follow common words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import stored
from docloom.llm.components import component_roots

# Common words of English, Spanish, French and German, after which a chain starts.
COMMON_WORDS = (
    "a an and are as at be but by for from had has he in is it not of on or that the there this to was were which with",
    "al con de del el en es la las lo los no para por que se su un una y",
    "au aux ce dans des du elle est et il le les ne ou par pas pour qui sur une",
    "auf das dem den der die ein eine für im ist mit nicht sich und von zu",
)
CHAIN = 2  # content words of a chain
BARE = 6  # content words that must follow a chain that no common word precedes
_MARK = "\x01"
RANGES = 8  # of ids, per partition


def with_spots(df: DataFrame, text_col: str, name: str, chain: int = CHAIN) -> DataFrame:
    """df with column `name`: the distinct spot signatures of a text as a sorted array of 32-bit hashes in hex.

    Words are runs of letters and digits in lower case; null text counts as empty. A spot is the chain of the next
    `chain` words that aren't common after a common word; common words between them are left out. In a stretch of words
    that aren't common each run of `chain` with BARE more behind it is a spot too, so that lists and tables have spots.
    A text without a spot has one signature for each run of `chain` words, or one for all of its words if they are
    fewer. Each step is a projection of its own, so that none is evaluated twice.
    """
    common = sorted({w for line in COMMON_WORDS for w in line.split()})
    mark, word, t = F.lit(_MARK), rf"[^{_MARK} ]++ ", [f"__{name}_{i}" for i in range(3)]
    spot = rf"(?<= )(?=((?:(?<={_MARK} ){f'(?:{_MARK} )*+'.join([word] * chain)})|(?:{word * chain}(?=(?:{word}){{{BARE}}}))))"
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.concat(F.lit(" "), F.array_join(F.transform(F.col(t[0]), lambda w: F.when(w.isin(common), mark).otherwise(w)), " "), F.lit(" "))
    runs = F.regexp_extract_all(F.concat(F.lit(" "), F.array_join(t[0], " "), F.lit(" ")), F.lit(rf"(?<= )(?=({'[^ ]++ ' * chain}))"), F.lit(1))
    found = F.regexp_extract_all(marked, F.lit(spot), F.lit(1))
    whole = F.array(F.array_join(t[0], " "))
    df = df.withColumn(t[0], words).withColumn(t[1], found)
    marks = lambda c: F.substring(F.md5(c), 1, 8)
    df = df.withColumn(t[2], F.when(F.size(t[1]) > 0, F.transform(t[1], lambda c: marks(F.replace(c, F.lit(_MARK + " "), F.lit(""))))).when(F.size(t[0]) >= chain, F.transform(runs, marks)).otherwise(F.transform(whole, marks)))
    return df.withColumn(name, F.array_sort(F.array_distinct(t[2]))).drop(*t)


def written(signatures: Column) -> Column:
    """A fingerprint's text: its signatures in order, by commas."""
    return F.array_join(signatures, ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two signature sets."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, signatures) for every row of docs; nulls as in with_spots(), repeated rows a row each, an empty table nothing."""
    return with_spots(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "signatures").select("doc_id", "signatures")


def similar(prints: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of fingerprints(): members has (doc_id, class_id, links, component_id) for every row, pairs has
    (a, b, likeness) between classes.

    Rows of equal signatures form one class, named by a hash of them. Sets are dealt by length: bands grow by
    1 / threshold, so a set meets only those of its own and the next band. In a band a pair is a candidate if it shares
    one of the sets' rarest signatures, as many as a set could miss and still reach the threshold; a candidate of too
    different a length is pruned before the sets are compared. links counts a class's pairs; component_id is the least
    doc_id that pairs lead to. Null ids stay; an empty table gives empty results.
    """
    keyed = prints.withColumn("class_id", F.xxhash64("signatures"))
    classes = stored(keyed.groupBy("class_id").agg(F.first("signatures").alias("signatures"), F.min("doc_id").alias("least")), "spot-classes")
    band = F.floor(F.log(F.greatest(F.size("signatures"), F.lit(1)).cast("double")) / F.log(F.lit(1 / threshold))).cast("int")
    sets = classes.select("class_id", "signatures", F.size("signatures").alias("len"), band.alias("band"))
    spread = sets.withColumn("sig", F.explode("signatures"))
    counts = spread.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = spread.select("class_id", "len", "band", "sig").join(counts, "sig").groupBy("class_id", "len", "band").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    missing = F.col("len") - F.ceil(F.col("len") * threshold) + 1
    rare = ranked.withColumn("sig", F.explode(F.slice("order", 1, missing.cast("int")))).select("class_id", "len", "band", F.col("sig.sig").alias("sig"))
    left = rare.withColumn("at", F.explode(F.array("band", F.col("band") + 1)))
    right = rare.select(F.col("class_id").alias("b"), F.col("len").alias("len_b"), F.col("band").alias("at"), "sig")
    close = (F.col("len_b") >= threshold * F.col("len")) & (F.col("len") >= threshold * F.col("len_b"))
    candidates = left.join(right, ["at", "sig"]).where(close & ((F.col("band") < F.col("at")) | (F.col("class_id") < F.col("b")))).select(F.col("class_id").alias("a"), "b").distinct()
    of = lambda n: classes.select(F.col("class_id").alias(n), F.col("signatures").alias(f"sig_{n}"))
    scored = candidates.join(of("a"), "a").join(of("b"), "b").select("a", "b", likeness(F.col("sig_a"), F.col("sig_b")).alias("likeness"))
    pairs = stored(scored.where(F.col("likeness") >= threshold), "spot-pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    roots = component_roots(pairs, "a", "b").withColumnRenamed("node", "class_id")
    rooted = classes.select("class_id", "least").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.join(least, "root").select("class_id", "component_id").join(links, "class_id", "left")
    return keyed.select("doc_id", "class_id").join(labelled, "class_id").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), pairs


def _place(value: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are at most value, found by two short searches."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    groups = [splits[i : i + step] for i in range(0, len(splits), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda s: s <= value))
    full = upto(F.array(*[F.lit(g[-1]) for g in groups]))
    rest = F.element_at(F.array(*[F.array(*[F.lit(s) for s in g]) for g in groups]), F.least(full + 1, F.lit(len(groups))))
    return F.when(full == len(groups), F.lit(len(splits))).otherwise(full * step + upto(rest))


def with_next(docs: DataFrame, id_col: str, text_col: str, parts: int, more: Callable[[DataFrame], DataFrame] | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, next_text, and x and next_x for each x in names, which more adds) for every row: what the row after it holds, in
    order of id (nulls first; equal ids by a hash of the text), after the last the first.

    Rows are dealt to ranges of ids, once. Each range also gets the first row of the range after it, so that a window
    within a range sees every row's successor; no task orders more than a range.
    """
    low = -(2**63)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # several ranges per partition, so that partitions come out even
    n = RANGES * parts
    cuts = rows.select(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n).alias("s")).first()["s"] if parts > 1 else None
    splits = sorted(set(cuts or []))
    ranges = rows.select("k", _place(F.col("k"), splits).alias("range")).groupBy("range").agg(F.min("k").alias("first")).orderBy("range").collect()
    firsts = [r["first"] for r in ranges]  # one per range
    rows = rows.withColumn("range", _place(F.col("k"), firsts) - 1)
    lead = F.col("k") == F.element_at(F.array(*[F.lit(f) for f in firsts or [0]]), (F.col("range") + 1).cast("int"))
    own = F.struct(F.col("range").alias("r"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("range") - 1, F.lit(max(1, len(firsts)))).alias("r"), F.lit(1).alias("guest"))
    dealt = rows.withColumn("to", F.explode(F.when(lead, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "k", "text", F.col("to.r").alias("r"), F.col("to.guest").alias("guest"))
    dealt = dealt.repartition(parts, "r")
    dealt = more(dealt) if more else dealt
    order = Window.partitionBy("r").orderBy("guest", "k", F.xxhash64("text"))
    names = ("text", *names)
    return dealt.select("doc_id", "guest", *names, *[F.lead(n).over(order).alias(f"next_{n}") for n in names]).where("guest = 0").drop("guest")


def edited(text: Column, other: Column) -> Column:
    """text with its last quarter of code points, rounded down, replaced by the first as many of other, or all of it."""
    n = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - n), F.substring(other, F.lit(1), n))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row: its
    fingerprint beside that of its edited text and of the next document."""
    parts = parts or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = with_next(docs, id_col, text_col, parts, lambda df: with_spots(df, "text", "spots"), ("spots",))
    found = with_spots(found.select("doc_id", "text", "spots", "next_spots", edited(F.col("text"), F.col("next_text")).alias("edited")), "edited", "edited_spots")
    return found.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), written(F.col("spots")).alias("fingerprint"), written(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )
