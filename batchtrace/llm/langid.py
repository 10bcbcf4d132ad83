"""Language identification by words first, character n-grams for unseen words.

A known word contributes its log frequency in each language. An unseen word contributes the mean
log frequency of its longest known n-grams: of length 5 if any of those is known, else 4, 3, 2, 1.
Spark counts words and n-grams of the training rows; the scorer is a pandas UDF over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from batchtrace.llm.shared import ship, store

ORDERS = (5, 4, 3, 2, 1)
#: Bounds of the model: training documents (about), words and n-grams kept. Each language has an equal
#: share of them (all it has, if fewer), its most frequent keys first.
MAX_TRAIN, MAX_WORDS, MAX_GRAMS = 30_000, 60_000, 60_000
#: Words that count at most as independent evidence in the posterior.
EVIDENCE = 30
CACHE, PART = 300_000, 50_000


def chunk_word(chunk: str) -> str:
    """The word in a white-space-free, lower-cased chunk: from its first to its last letter."""
    if chunk.isalpha():
        return chunk
    at = [i for i, c in enumerate(chunk) if c.isalpha()]
    return chunk[at[0]:at[-1] + 1] if at else ""


def grams(word: str, n: int) -> list[str]:
    w = f" {word} " if n > 1 else word
    return [w[i:i + n] for i in range(len(w) - n + 1)]


def _count_words(batches):
    for pdf in batches:
        counts: dict[str, Counter] = {}
        for text, lang, times in zip(pdf["text"], pdf["lang"], pdf["times"], strict=True):
            own = counts.setdefault(lang, Counter())
            if times == 1:
                own.update(text.lower().split())
            else:
                for chunk, n in Counter(text.lower().split()).items():
                    own[chunk] += n * times
        rows = Counter()
        for lang, c in counts.items():
            for chunk, n in c.items():
                if w := chunk_word(chunk):
                    rows[lang, w] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in rows.items()], columns=["lang", "key", "n"])


def _count_grams(batches):
    for pdf in batches:
        rows = Counter()
        for lang, w, n in zip(pdf["lang"], pdf["key"], pdf["n"], strict=True):
            for k in ORDERS:
                for g in grams(w, k):
                    rows[lang, g] += n
        yield pd.DataFrame([(a, b, n) for (a, b), n in rows.items()], columns=["lang", "key", "n"])


def _logs(rows: pd.DataFrame, totals: dict, langs: list[str], kind) -> dict[str, tuple]:
    """key -> log frequency per language, add-half smoothed. ``kind`` gives a key's total class."""
    at = {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, list[float]] = {}
    for lang, key, n in zip(rows["lang"], rows["key"], rows["n"], strict=True):
        counts.setdefault(key, [0.0] * len(langs))[at[lang]] = float(n)
    return {k: tuple(math.log((c + 0.5) / (totals.get((lang, kind(k)), 0) + 1000.0)) for c, lang in zip(v, langs, strict=True))
            for k, v in counts.items()}


class Model:
    """Bounded tables of log frequencies; scores one text at a time."""

    def __init__(self, langs, prior, words, grams_):
        self.langs, self.prior, self.words, self.grams = langs, np.array(prior), words, grams_
        self.rows = None

    def __getstate__(self):
        return self.langs, self.prior, self.words, self.grams

    def __setstate__(self, state):
        self.langs, self.prior, self.words, self.grams = state
        self.rows = None

    def vector(self, word: str) -> tuple | None:
        """Log frequency per language of a word, or of its longest known n-grams; None: nothing known."""
        if (v := self.words.get(word)) is not None:
            return v
        for n in ORDERS:
            if found := [x for g in grams(word, n) if (x := self.grams.get(g)) is not None]:
                return tuple(sum(c) / len(found) for c in zip(*found, strict=True))
        return None

    def score(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text:
            return "und", 0.0
        if self.rows is None:
            self.rows = _Rows(self)
        total, known, lettered, chunks = np.zeros(len(self.langs)), 0, False, text.lower().split()
        for a in range(0, len(chunks), PART):
            if len(self.rows) + PART > CACHE:  # only between parts, so that the ids of a part stay valid
                self.rows = _Rows(self)
            ids = np.array(list(map(self.rows.__getitem__, chunks[a:a + PART])))
            lettered = lettered or bool((ids > 0).any())
            known += int((ids > 1).sum())
            total += self.rows.matrix[ids].sum(axis=0)
        if not lettered:
            return "und", 0.0
        z = self.prior + (total * (min(known, EVIDENCE) / known) if known else 0)
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


class _Rows(dict):
    """Cache from chunk to a row of the score matrix: row 0 has no letter, row 1 nothing known."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.used, self.matrix = model, 2, np.zeros((1024, len(model.langs)))

    def __missing__(self, chunk: str) -> int:
        word = chunk_word(chunk)
        v = self.model.vector(word) if word else None
        if v is None:
            r = 1 if word else 0
        else:
            r, self.used = self.used, self.used + 1
            if r >= len(self.matrix):
                self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[r] = v
        self[chunk] = r
        return r


def train(rows: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Model from text and lang of ``rows`` (nulls are left out).

    Fitted on about ``max_train`` rows: an equal number of each language, or all of one that has fewer,
    drawn row by row (by a hash of text and place), so copies of a text are drawn apart. The tables
    collected to the driver have at most ``max_words`` and ``max_grams`` keys, an equal number of each
    language's most frequent ones (ties in order of the keys). The prior is each language's share of all
    rows given, not of the drawn ones."""
    ship(rows.sparkSession)
    rows = rows.select("text", "lang").where("text is not null and lang is not null")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(found)
    each = max_train / max(1, len(langs))
    drawn = rows.withColumn("u", F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(1 << 30)))
    share = rows.sparkSession.createDataFrame([(k, int(min(1.0, each / n) * (1 << 30))) for k, n in found.items()], "lang string, below long")
    drawn = drawn.join(F.broadcast(share), "lang").where("u < below")  # a row a language
    # equal texts are put together before the shuffle, so a frequent one is one row
    drawn = drawn.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("times"))
    schema = "lang string, key string, n long"
    words = store(drawn.mapInPandas(_count_words, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")), "lang-words")
    gram_rows = store(words.mapInPandas(_count_grams, schema).groupBy("lang", "key").agg(F.sum("n").alias("n")), "lang-grams")

    def top(t: DataFrame, k: int) -> pd.DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
        keys = t.withColumn("rank", rank).where(F.col("rank") <= k // max(1, len(langs))).select("key").distinct()
        return t.join(F.broadcast(keys), "key").toPandas()  # at most k keys

    totals = {(r["lang"], r["k"]): r["n"] for t, k in ((words, F.lit(0)), (gram_rows, F.length("key")))
              for r in t.groupBy("lang", k.alias("k")).agg(F.sum("n").alias("n")).collect()}
    prior = [math.log(found[lang] / sum(found.values())) for lang in langs]
    return Model(langs, prior, _logs(top(words, max_words), totals, langs, lambda k: 0),
                 _logs(top(gram_rows, max_grams), totals, langs, len))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus lang_pred and score (replacing columns of those names).

    ``und`` with score 0 where text is null, empty or has no letter, or the model has no language.
    Whole texts are scored, repeated rows alike; ties go to the first language in sorted order."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([m.score(t) for t in texts], columns=["lang_pred", "score"])

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*keep).alias("_row"), predict("text").alias("_p"))
    return rows.select("_row.*", "_p.lang_pred", "_p.score")
