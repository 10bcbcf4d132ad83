"""Substring dedup by sliding runs of consecutive sentences.

Every run of consecutive sentences of every document is hashed: a run begins (or ends) at any
sentence and takes two, or as many as it needs to hold MIN_WORDS words, so no sentence is too short to
count. Long sentences are cut further behind words chosen by their hash, alike wherever they stand.
The hashes of all documents are counted in one shuffle (with partial sums, so a passage found everywhere
is one row a task); only runs whose hash may repeat are shuffled again, to find the first one.
Sentences covered by a repeated run that is not its first occurrence are removed; the rest of the
text stays as it was, white space included.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from batchtrace.llm.shared import ship, store

RUN = 2
MIN_WORDS = 16
#: Of every so many neighbouring words of a sentence, the one with the smallest hash ends a piece.
WINDOW = 17
#: Bits of the filter of repeated runs: at most BITS / 64 rows of two longs (4 MB), whatever the corpus;
#: with more repeated runs only more others are shuffled.
BITS = 1 << 24
#: A sentence ends after . ! or ? before white space, or at a line end; it owns the white space behind it.
_END = re.compile(r"[.!?][ \t\n\x0b\f\r]+|\n[ \t\n\x0b\f\r]*")
_WORD = re.compile(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*")
_PLACE = (1 << 23) - 1
#: Word keys remembered, and words of long sentences cut at once.
_KEYS, _HELD = 1 << 16, 1 << 16
#: Odd factor of the polynomial over a run's sentence hashes.
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "struct<n: int, h: array<bigint>, at: array<bigint>>"


class _Keys(dict):
    """40 bits of each word's MD5 (a hash that SQL engines have too)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEYS:
            self.clear()
        k = self[word] = int(hashlib.md5(word).hexdigest()[:10], 16)
        return k


def _cuts(sentences: list[list[bytes]], window: int, keys: _Keys) -> list[list[int]]:
    """Last places of the pieces of each sentence: behind the word with the smallest key (ties: the last)
    of every ``window`` neighbouring words, and at its end."""
    sizes = np.array([len(w) for w in sentences])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    key = np.fromiter((keys[x] for w in sentences for x in w), np.int64, n)
    least = (key << 23) | (_PLACE - np.arange(n))
    size = 1
    while size < window:  # minimum of twice as many neighbours in each step
        step = min(size, window - size)
        least = np.minimum(least[:len(least) - step], least[step:])
        size += step
    within = np.arange(n - window + 1) + window <= np.repeat(ends, sizes)[:n - window + 1]
    places = np.unique(np.concatenate((_PLACE - (least[within] & _PLACE), ends - 1)))
    at = np.searchsorted(places, ends)
    starts = ends - sizes
    return [(places[a:b] - c).tolist() for a, b, c in zip([0, *at[:-1]], at, starts, strict=True)]


def pieces(text: str, window: int, keys: _Keys) -> tuple[list[int], list[int], list[int]]:
    """(ends, words, digests): where each sentence of a text ends, its number of words, and the hash of its
    lower-cased words. Sentences of ``window`` words or more are cut: no piece is longer than that, and
    a cut depends on the words near it alone. Words are not kept beyond some sentences."""
    found: list = []
    long_, held = [], 0

    def cut() -> None:
        for (i, a, b, w), last in zip(long_, _cuts([w for _, _, _, w in long_], window, keys), strict=True):
            stops = [a + m.end() for m in _WORD.finditer(text[a:b])] if len(last) > 1 else None
            found[i] = [(stops[e] if stops else b, e - f, xxhash.xxh64_intdigest(b" ".join(w[f + 1:e + 1]), 42))
                        for f, e in zip([-1, *last[:-1]], last, strict=True)]
        long_.clear()

    a, end = 0, len(text)
    while a < end:
        m = _END.search(text, a + 1)
        b = m.end() if m else end
        w = text[a:b].lower().encode().split()
        n = len(w)
        if n < window or n > _PLACE:  # places of words have 23 bits
            found.append((b, n, xxhash.xxh64_intdigest(b" ".join(w), 42)))
        else:
            if held + n > _HELD and long_:
                cut()
                held = 0
            long_.append((len(found), a, b, w))
            held += n
            found.append(None)
        a = b
    if long_:
        cut()
    flat = [x for f in found for x in (f if type(f) is list else (f,))]
    return [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]


def run_hashes(words: list[int], digests: list[int], run: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of every run, in order of its first sentence: sentences i.. onwards and ..j backwards
    until both bounds are met. place holds first << 32 | count << 1 | whether an equal run came before."""
    n = len(words)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(np.array(words, np.int64))))
    first = np.arange(n)
    end = np.maximum(first + run, np.searchsorted(total, total[:-1] + min_words))
    last = np.arange(1, n + 1)
    start = np.minimum(last - run, np.searchsorted(total, total[1:] - min_words, side="right") - 1)
    onward, back = end <= n, start >= 0
    back &= end[np.maximum(start, 0)] != last
    a = np.concatenate((first[onward], start[back]))
    b = np.concatenate((end[onward], last[back]))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    digest = np.array(digests, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64))))), dtype=np.uint64)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(digest * power[:-1], dtype=np.uint64)))
        h = ((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)).view(np.int64)
    _, where = np.unique(h, return_index=True)
    again = np.ones(len(h), np.int64)
    again[where] = 0
    return h, (a << 32) | ((b - a) << 1) | again


def dedup_spans(docs: DataFrame, carry: list[str] | None = None, run: int = RUN, min_words: int = MIN_WORDS,
                window: int = WINDOW) -> DataFrame:
    """``carry`` columns (default: all) with ``text`` after removal, plus n_pieces and n_removed.

    Pieces are sentences, and the parts of sentences of ``window`` words or more. A run takes ``run``
    pieces at least, and as many as hold ``min_words`` words; so a repeated passage is removed from its
    first whole piece to its last, whatever the length of its pieces. Two copies of w words have equal
    pieces of w - 2 * window + 1 words or more between them, so with the defaults (18 words, two
    pieces) any passage of 51 words or more loses all but the ends of its later copies.
    Words are compared after lower-casing and with white space collapsed, runs by 64-bit hashes;
    sentence ends must be the same in both places. The first occurrence is the one with the smallest
    doc_id (null last), then the smallest place; of repeated rows with the same doc_id one row is
    first. Null text stays null, with no pieces; texts of fewer than ``run`` pieces are not changed.
    Empty table: empty result. Input columns n_pieces and n_removed are replaced.
    """
    ship(docs.sparkSession)
    added = ["n_pieces", "n_removed"]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in (*added, "text")]

    @F.pandas_udf(RUNS)
    def runs_of(texts: pd.Series) -> pd.DataFrame:
        keys, out = _Keys(), []
        for t in texts:
            _, words, digests = pieces(t or "", window, keys)
            out.append((len(words), *run_hashes(words, digests, run, min_words)))
        return pd.DataFrame(out, columns=["n", "h", "at"])

    @F.pandas_udf("struct<text: string, removed: int>")
    def without(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        keys, out = _Keys(), []
        for t, found in zip(texts, places, strict=True):
            if found is None:
                out.append((None, 0))
                continue
            ends = pieces(t, window, keys)[0]
            gone, at = np.zeros(len(ends) + 1, np.int64), np.asarray(found, np.int64)
            np.add.at(gone, at >> 32, 1)
            np.add.at(gone, (at >> 32) + ((at & 0xFFFFFFFF) >> 1), -1)
            cover = (np.cumsum(gone[:-1]) > 0).tolist()
            out.append(("".join(t[a:b] for a, b, g in zip([0, *ends[:-1]], ends, cover, strict=True) if not g), sum(cover)))
        return pd.DataFrame(out, columns=["text", "removed"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"),
                       F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_rank"), F.monotonically_increasing_id().alias("_rid"),
                       F.col("text"), runs_of("text").alias("_r"))
    rows = store(rows, "span-rows")

    # hashes alone are counted first; the filter of the repeated ones keeps most runs out of the second shuffle
    repeated = rows.select(F.explode("_r.h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slot = F.col("h").bitwiseAND(F.lit(BITS - 1))
    filt = store(repeated.groupBy(F.shiftright(slot, 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("_mask")), "span-filter")
    found = rows.select("_rid", "_rank", F.explode(F.arrays_zip("_r.h", "_r.at")).alias("x")).select("_rid", "_rank", "x.h", "x.at")
    hits = (found.join(F.broadcast(filt), F.shiftright(slot, 6) == F.col("_word"))  # at most BITS / 64 rows
            .where("(shiftrightunsigned(_mask, cast(h & 63 as int)) & 1L) = 1L").drop("_word", "_mask"))
    first = store(hits.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min_by("_rid", "_rank").alias("first"))
                  .where("n > 1").select("h", "first"), "span-first")
    gone = (hits.drop("_rank").join(first, "h").where("(at & 1L) = 1L or _rid <> first")
            .groupBy("_rid").agg(F.collect_list("at").alias("_at")))
    out = rows.select("_row", "_rid", "text", F.col("_r.n").cast("long").alias("n_pieces")).join(gone, "_rid", "left")
    # only changed texts go to Python again
    out = out.withColumn("_o", without(F.when(F.col("_at").isNotNull(), F.col("text")), "_at"))
    return out.select("_row.*", F.when(F.col("_at").isNull(), F.col("text")).otherwise(F.col("_o.text")).alias("text"),
                      "n_pieces", F.col("_o.removed").cast("long").alias("n_removed"))
