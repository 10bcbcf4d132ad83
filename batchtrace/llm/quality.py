"""Quality rules: repetition and symbol counts, and divergence from language references.

Each text's character-class histogram and common-word histogram are compared with the summed
histograms of its language by Jensen-Shannon distance (base 2, 0 to 1). One pass over the texts
computes all counts without a shuffle; the references are sums per language over that table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.llm.shared import store, words

# Frequent function words of the languages that have a reference.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "this"],
    "de": ["der", "die", "und", "das", "von", "zu", "mit", "den", "ist", "nicht", "ein", "auf"],
    "fr": ["le", "les", "et", "des", "un", "une", "du", "est", "pour", "dans", "qui", "pas"],
    "es": ["el", "los", "las", "de", "la", "que", "en", "y", "se", "del", "por", "con"],
}
WORD_LIST = [w for ws in COMMON.values() for w in ws]
#: Classes counted by one pattern each; white space and the rest are found by subtraction.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": r"[#*$%&|<>]", "punct": r"[.,;:!?'\"()\-]",
           "other": r"[^\x00-\x7F]"}

MAX_CHAR_JS = 0.25
#: The limit of the word distance falls with length, as the distance of a sample from its source does:
#: MAX_WORD_JS + WORD_NOISE / sqrt(words).
MAX_WORD_JS = 0.25
WORD_NOISE = 0.7
#: Lengths from which on the distances count.
MIN_CHARS = 600
MIN_WORDS = 50


def _hists(text: Column) -> list[Column]:
    return [F.regexp_count(text, F.lit(p)).cast("double") for p in CLASSES.values()]


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two
    histograms _chars and _words. Row-local: sorts and set operations on one row's arrays only."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_w", words(F.col("_t")))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    # 64-bit hashes of the 5-word windows; equal windows are found by sorting (hash, position)
    d = d.withColumn("_g", F.expr("""
        case when size(_h) < 6 then cast(array() as array<bigint>) else transform(sequence(0, size(_h) - 5),
             i -> xxhash64(_h[i], _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4])) end"""))
    d = d.withColumn("_s", F.expr("""
        case when size(array_distinct(_g)) = size(_g) then cast(array() as array<struct<h: bigint, i: int>>)
             else sort_array(transform(_g, (x, i) -> struct(x as h, i as i))) end"""))
    d = d.withColumn("_p", F.expr("""
        sort_array(transform(filter(_s, (e, k) -> (k > 0 and _s[k - 1].h = e.h)
                                 or (k + 1 < size(_s) and _s[k + 1].h = e.h)), e -> e.i))"""))
    # a repeated window covers 5 words, or as many as lie before the next repeated window
    repeat = F.expr("""aggregate(transform(_p, (p, k) -> case when k + 1 < size(_p) then least(5, _p[k + 1] - p)
                                                             else 5 end), 0L, (a, x) -> a + x)""")
    lines = r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    d = d.withColumn("_l", F.expr(lines))
    c = _hists(F.col("_t"))
    n = F.length("_t")
    word_chars = F.length(F.array_join("_w", ""))
    d = (d.withColumn("n_words", F.size("_w").cast("long"))
         .withColumn("word_chars", word_chars.cast("long"))
         .withColumn("n_symbols", c[2].cast("long"))
         .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
         .withColumn("n_repeat_words", repeat.cast("long")))
    space = (n - F.col("word_chars")).cast("double")
    rest = n.cast("double") - space - reduce(lambda a, b: a + b, c)
    longest = max(map(len, WORD_LIST))
    common = F.filter("_w", lambda w: (F.length(w) <= longest) & F.lower(w).isin(WORD_LIST))
    d = (d.withColumn("_chars", F.array(*c, space, rest)).withColumn("_c", common)
         .withColumn("_j", F.lower(F.concat(F.lit(" "), F.array_join("_c", "  "), F.lit(" ")))))
    # every listed word stands between two blanks of its own, so its count follows from what replacing it removes
    hits = [((F.length("_j") - F.length(F.replace("_j", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)) for w in WORD_LIST]
    d = d.withColumn("_words", F.array(*hits, (F.col("n_words") - F.size("_c")).cast("double")))
    return d.drop("_t", "_w", "_h", "_g", "_s", "_p", "_l", "_c", "_j")


def _sums(rows: DataFrame, col: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(col)[i]) for i in range(n)])


def _js(p: str, q: str) -> str:
    """SQL for the Jensen-Shannon distance of two count arrays; null if either is all zero."""
    sp, sq = (f"aggregate({x}, 0D, (a, v) -> a + v)" for x in (p, q))
    term = ("case when x.{0} > 0 then x.{0} * log2(2 * x.{0} / (x.p + x.q)) else 0D end")
    pair = f"zip_with({p}, {q}, (p, q) -> named_struct('p', p / {sp}, 'q', q / {sq}))"
    both = f"aggregate({pair}, 0D, (a, x) -> a + {term.format('p')} + {term.format('q')})"
    return f"case when {sp} > 0 and {sq} > 0 then sqrt(greatest(0D, {both} / 2)) end"


def quality_rules(docs: DataFrame, carry: list[str] | None = None, max_char_js: float = MAX_CHAR_JS,
                  max_word_js: float = MAX_WORD_JS, word_noise: float = WORD_NOISE, min_chars: int = MIN_CHARS,
                  min_words: int = MIN_WORDS) -> DataFrame:
    """``carry`` columns (default: all) plus the base counts, base_failed, char_js, word_js, kept.

    base_failed: fewer than 10 words, or more than 20 % of the words lie in 5-word windows that
    occur twice or more. kept: not base_failed and both distances to the reference of the row's
    language within their limits (``max_char_js``; ``max_word_js`` + ``word_noise`` / sqrt(n_words)); a
    distance counts only from ``min_chars`` characters or ``min_words`` words on. References are summed over every row that passes the base rules;
    languages without a word list, and null, use the sum over all languages. Null text: no words
    (base_failed). Repeated rows: each is judged alike. Empty table: empty result. Input columns
    with the names of result columns are replaced. Windows are compared by 64-bit hashes.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
             "char_js", "word_js", "kept"]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in added]
    lang = F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise("*")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), lang.alias("_lang"),
                       F.col("text").alias("text"), F.length("text").alias("_n"))
    rows = base_counts(rows).withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    rows = store(rows.drop("text"), "quality")
    nc, nw = len(CLASSES) + 2, len(WORD_LIST) + 1
    good = rows.where("not base_failed")
    # at most one row a language of the fixed list and one for all: bounded, so broadcast
    per = good.groupBy("_lang").agg(_sums(good, "_chars", nc).alias("_qc"), _sums(good, "_words", nw).alias("_qw"))
    pooled = good.agg(_sums(good, "_chars", nc).alias("_qc"), _sums(good, "_words", nw).alias("_qw"))
    refs = per.where("_lang <> '*'").unionByName(pooled.withColumn("_lang", F.lit("*")))
    out = rows.join(F.broadcast(refs), "_lang", "left")
    out = out.withColumn("char_js", F.round(F.expr(_js("_chars", "_qc")), 6))
    out = out.withColumn("word_js", F.round(F.expr(_js("_words", "_qw")), 6))
    far = (((F.coalesce("_n", F.lit(0)) >= min_chars) & (F.coalesce("char_js", F.lit(0.0)) > max_char_js))
           | ((F.col("n_words") >= min_words)
              & (F.coalesce("word_js", F.lit(0.0)) > F.lit(max_word_js) + F.lit(word_noise) / F.sqrt("n_words"))))
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select("_row.*", *added)
