"""Language identification: word first, then character n-grams of falling length."""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import arrow_append, arrow_map, stored

_WORD = regex.compile(r"\p{L}+")
LONGEST, UNKNOWN = 5, "und"
_KEPT, _WRITTEN = 1 << 20, 1 << 24  # numbers kept for unseen words, and for all grams written out


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and n-grams per language, and the backoff between them.

    A known word scores by its log frequency in each language. An unseen word scores by the mean of its known n-grams
    of the greatest length at which any is known, LONGEST first, less a constant per step down. Evidence of a text is
    the mean over its words. A gram holds only the languages that it occurs in; `base` has the log frequency of an
    unseen gram of each length in each language.
    """

    def __init__(self, langs: list[str], entries: list[tuple[int, str, str, int]]):
        """entries: (n, gram, language, count); n is 0 for words."""
        self.langs, at = langs, {x: i for i, x in enumerate(langs)}
        self.grams: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]  # to rows
        cells = sorted((n, gram, at[lang], count) for n, gram, lang, count in entries)
        ns, rows = np.array([c[0] for c in cells], int), []
        for n, gram, _, _ in cells:
            rows.append(self.grams[n].setdefault(gram, len(self.grams[n]) + sum(len(g) for g in self.grams[:n])))
        self.lang, counts = np.array([c[2] for c in cells], np.int32), np.array([c[3] for c in cells], float)
        sizes = np.array([n for n in range(LONGEST + 1) for _ in self.grams[n]], int)
        self.starts = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(sizes)))].astype(np.int64) if rows else np.zeros(1, np.int64)
        totals = np.zeros((LONGEST + 1, len(langs)))
        np.add.at(totals, (ns, self.lang), counts)
        totals += 0.5 * np.bincount(sizes, minlength=LONGEST + 1)[:, None]
        self.base = np.log(0.5 / (totals + 1.5))
        # what a count adds to the base, and each row's greatest value, by which it is lowered
        self.more = np.log(counts + 0.5) - np.log(0.5)
        self.sizes = sizes
        step = max(1, _WRITTEN // max(1, len(langs)))
        self.top = np.concatenate([np.empty(0), *(self._rows(at, at + step).max(axis=1) for at in range(0, len(sizes), step))])
        self._reset()

    def _rows(self, lo: int, hi: int) -> np.ndarray:
        """The rows lo to hi, written out: a gram's log frequency in each language."""
        hi = min(hi, len(self.sizes))
        out = self.base[self.sizes[lo:hi]]
        part = slice(self.starts[lo], self.starts[hi])
        out[np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1])), self.lang[part]] += self.more[part]
        return out

    def _reset(self) -> None:
        """Forgets the rows of unseen words. With few languages all grams' rows are written out, which sums faster."""
        words, width = len(self.grams[0]), len(self.langs)
        self.dense = None
        if len(self.top) * width <= _WRITTEN:
            self.dense = self._rows(0, len(self.top)) - self.top[:, None]
        kept = words if self.dense is not None else 0
        self.places, self.used = dict(self.grams[0]) if kept else {}, kept
        self.rows = np.vstack([self.dense[:kept] if kept else np.zeros((0, width)), np.zeros((1024, width))])

    def backoff(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            get = self.grams[n].get
            found = [i for g in grams(word, n) if (i := get(g)) is not None]
            if found:
                row = self.summed(np.array(found), n) / len(found)
                return (row - row.max()) * 0.8 ** (LONGEST + 1 - n)
        return np.zeros(len(self.langs))

    def summed(self, found: np.ndarray, n: int) -> np.ndarray:
        """The sum of the rows of some grams of one length, each lowered by its greatest value."""
        if self.dense is not None:
            return self.dense[found].sum(axis=0)
        lo = self.starts[found]
        count = self.starts[found + 1] - lo
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(lo - ends + count, count)
        return self.base[n] * len(found) + np.bincount(self.lang[at], weights=self.more[at], minlength=len(self.langs)) - self.top[found].sum()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("dense", "places", "used", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def place(self, word: str) -> int:
        at = self.used
        if at == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows[: max(1024, at // 2)])])
        self.rows[at], self.places[word] = self.backoff(word), at
        self.used += 1
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        known = self.grams[0]
        if (len(self.places) - len(known) * (self.dense is not None)) * len(self.langs) > _KEPT:
            self._reset()
        get, place = self.places.get, self.place  # of the words kept after a reset
        if self.dense is not None:
            idx = [i if (i := get(w)) is not None else place(w) for w in words]
            total = self.rows[idx].sum(axis=0)
        else:
            old = [i for w in words if (i := known.get(w)) is not None]
            new = [i if (i := get(w)) is not None else place(w) for w in words if w not in known]
            total = (self.summed(np.array(old), 0) if old else 0) + (self.rows[new].sum(axis=0) if new else 0)
        mean = total / len(words)
        odds = np.exp((mean - mean.max()) * min(len(words), 25))
        best = int(mean.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def train(labelled: DataFrame, fit_docs: int = 6000, least: int = 2, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """A model from labelled rows (text and lang not null; others are left out). Every language among them is learned.

    It is fitted on a bounded sample: of each language about fit_docs over the number of languages rows (all, if it has
    fewer, and at least about 20), picked by a hash of the id and the text, with their whole texts. Words and n-grams
    that occur `least` times in the sample are known. The model's size is bounded by the sample's text.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    langs = sorted(r["lang"] for r in counts.select("lang").collect())
    quota = max(20, fit_docs // max(1, len(langs)))
    rows = rows.join(counts, "lang").where(F.pmod(F.xxhash64("id", "text", F.lit("fit")), F.lit(2**31)) < F.lit(float(quota)) / F.col("n") * F.lit(2.0**31)).select("lang", "text")

    def counted(batches):
        import pyarrow as pa

        per_lang: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                per_lang.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
        for lang, words in per_lang.items():
            found: Counter = Counter()
            for w, c in words.items():
                found[0, w] += c
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        found[n, g] += c
            keys = list(found)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(part), "n": pa.array([k[0] for k in part], pa.int32()), "gram": [k[1] for k in part], "c": pa.array([found[k] for k in part], pa.int64())})

    summed = rows.mapInArrow(counted, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    known = summed.where(F.col("c") >= least).select("n", "gram", "lang", "c").toArrow()
    return Model(langs, list(zip(*(known.column(i).to_pylist() for i in range(4)))))


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row: the likeliest learned language and its share of the evidence.

    Null text, a text without a letter, and any text if nothing was learned give `und` and 0. Ties go to the language
    that sorts first. Null ids and repeated rows stay; other columns aren't looked at. The model, bounded by train(),
    reaches the executors as a broadcast variable.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(columns):
        found = [shared.value.predict(t) for t in columns[1]]
        return [columns[0], [f[0] for f in found], [f[1] for f in found]]

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col), F.col(text_col)), rows, f"`{id_col}` {kind}, lang_pred string, score double")


def identify_rows(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df, every column kept, with lang_pred and lang_score as in identify(); columns of these names are replaced."""
    df = df.drop("lang_pred", "lang_score")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def values(texts):
        found = [shared.value.predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found]]

    return arrow_append(df, text_col, values, "lang_pred string, lang_score double")
