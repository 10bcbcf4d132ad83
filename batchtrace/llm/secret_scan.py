"""Secret scanning through a trigram inverted index, in DataFrame operations only.

Each rule's regex gives a Boolean trigram query: alternatives of trigrams that any match must
contain. The index holds (trigram, doc_id) postings for the trigrams that the rules ask for; the
postings of a document are intersected as bits, and only documents that satisfy a rule's query are
matched against that rule's regex. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre, _parser

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.llm.shared import store


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0        # group whose length counts
    min_length: int = 0   # shorter matches are dropped


# The base rules, then further token formats (public, documented prefixes).
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
LIMIT = 64  # alternatives a query may have; beyond it a part counts as unbounded


def _strings(token) -> set[str] | None:
    """All lower-cased strings a parsed regex part can match; None if unbounded or too many."""
    op, arg = token
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        chars = {chr(c).lower() for o, a in arg for c in ([a] if o is sre.LITERAL else range(a[0], min(a[1], a[0] + LIMIT) + 1))}
        return chars if len(chars) <= 8 else None
    if op is sre.SUBPATTERN:
        return _joined(arg[-1])
    if op is sre.BRANCH:
        parts = [_joined(p) for p in arg[1]]
        return None if None in parts or len(out := set().union(*parts)) > LIMIT else out
    if op is sre.MAX_REPEAT and arg[1] <= 3 and (one := _joined(arg[2])) is not None:
        out, now = set(), {""}
        for n in range(arg[1] + 1):
            out |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in one}
        return out if len(out) <= LIMIT else None
    return None


def _joined(tokens) -> set[str] | None:
    out = {""}
    for t in tokens:
        s = _strings(t)
        if s is None or len(out) * len(s) > LIMIT:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives (OR) of trigram sets (AND); empty if no trigram is mandatory."""
    runs, now = [], {""}
    for t in [*_parser.parse(pattern), (None, None)]:
        s = _strings(t) if t[0] is not None else None
        if s is not None and len(now) * len(s) <= LIMIT:
            now = {a + b for a in now for b in s}
        else:
            runs.append(now)
            now = s or {""}
    query = [frozenset()]
    for strings in runs:
        if all(len(s) >= 3 for s in strings):
            sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
            query = [a | b for a in query for b in sets]
            query = [q for q in set(query) if not any(o < q for o in query)]  # a < b: b is implied
    return sorted(query, key=sorted) if frozenset() not in query else []


def _spans(rule: Rule, order: int) -> Column:
    """Sorted spans of a rule in _t: the text between matches and the matches give the places."""
    pattern = F.lit(rule.pattern)
    value = F.regexp_extract_all("_t", pattern, F.lit(rule.group))
    found = F.regexp_extract_all("_t", pattern, F.lit(0))
    none = F.expr("cast(array() as array<struct<start: int, ord: int, kind: string, end: int>>)")
    between = F.split("_t", rule.pattern, -1)
    parts = F.arrays_zip(between.alias("gap"), found.alias("hit"), value.alias("value"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(p["value"]) >= max(1, rule.min_length), F.concat(a["spans"], span))
                        .otherwise(a["spans"]).alias("spans"))

    walked = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])
    return F.when(F.col("_t").rlike(rule.pattern), walked).otherwise(none)


def _joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Bits a rule of the candidates' broadcast: at most CANDIDATE_BITS / 64 rows of a long a rule, whatever the corpus.
CANDIDATE_BITS = 1 << 22


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(bit, doc_id): which of the trigrams (by place in the list) each lower-cased text holds."""
    low = docs.select("doc_id", F.lower("text").alias("t"))
    listed = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(t).alias("tri")) for i, t in enumerate(trigrams)])
    held = F.filter(listed, lambda x: F.contains(F.col("t"), x["tri"]))
    return low.select("doc_id", F.explode(F.transform(held, lambda x: x["bit"])).alias("bit"))


def scan_secrets(docs: DataFrame, carry: list[str] | None = None, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """``carry`` columns (default: all) of every row plus n_assign, n_access, n_hex, base_sha256, spans.

    A span is a rule's whole match in code points, end exclusive; matches are leftmost and do not
    overlap within a kind, and those too short are dropped. spans joins the spans of all rules,
    base_sha256 is the hash of the base rules' alone. Null text counts as empty. Rows are looked up
    by doc_id, so repeated rows are verified each; rows with a null doc_id, which the index cannot
    name, are scanned by every rule. Empty table: empty result. Input columns with the names of
    result columns are replaced.
    """
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    cols = [c for c in (docs.columns if carry is None else carry) if c not in added]
    rules = (*BASE, *more)
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for s in q for t in s})
    words = [trigrams[i:i + 63] for i in range(0, len(trigrams), 63)]  # 63 trigrams a bit mask
    index = store(postings(docs.where("doc_id is not null and text is not null"), trigrams), "trigram-postings")
    masks = index.groupBy("doc_id").agg(*[
        F.bit_or(F.expr(f"case when bit div 63 = {w} then shiftleft(1L, bit % 63) else 0L end")).alias(f"_m{w}") for w in range(len(words))])
    at = {t: divmod(i, 63) for i, t in enumerate(trigrams)}
    slot = F.pmod(F.xxhash64("_id"), F.lit(CANDIDATE_BITS))

    def holds(query: list[frozenset[str]]) -> Column:
        out = F.lit(False)
        for s in query:
            need = [sum(1 << at[t][1] for t in s if at[t][0] == w) for w in range(len(words))]
            one = F.lit(True)
            for w, m in enumerate(need):
                one = one & (F.col(f"_m{w}").bitwiseAND(F.lit(m)) == F.lit(m)) if m else one
            out = out | one
        return out

    indexed = [i for i, q in enumerate(queries) if q]
    found = masks.select(F.col("doc_id").alias("_id"), *[holds(queries[i]).alias(f"_c{i}") for i in indexed])
    # each rule's candidates as bits of hashed ids, 64 a row: a broadcast of bounded size, and no text is
    # shuffled; ids that share a bit are verified for nothing
    bit = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    sets = (found.where(" or ".join(f"_c{i}" for i in indexed) or "false").withColumn("_slot", slot)
            .groupBy((F.col("_slot") / 64).cast("long").alias("_word"))
            .agg(F.count(F.lit(1)).alias("_n"), *[F.bit_or(F.when(F.col(f"_c{i}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"_b{i}") for i in indexed]))
    sets = store(sets.drop("_n"), "secret-candidates")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"), F.col("doc_id").alias("_id"),
                       F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.withColumn("_slot", slot).join(F.broadcast(sets), (F.col("_slot") / 64).cast("long") == F.col("_word"), "left")
    for i in indexed:
        rows = rows.withColumn(f"_c{i}", F.expr(f"(shiftrightunsigned(coalesce(_b{i}, 0L), cast(_slot % 64 as int)) & 1L) = 1L"))
    for i, r in enumerate(rules):
        spans = _spans(r, i)
        if i in indexed:
            spans = F.when(F.col("_id").isNull() | F.coalesce(f"_c{i}", F.lit(False)), spans)
            spans = F.coalesce(spans, F.expr("cast(array() as array<struct<start: int, ord: int, kind: string, end: int>>)"))
        rows = rows.withColumn(f"_s{i}", spans)
    base = F.sort_array(F.concat(*[F.col(f"_s{i}") for i in range(len(BASE))]))
    all_ = F.sort_array(F.concat(*[F.col(f"_s{i}") for i in range(len(rules))]))
    return rows.select("_row.*", *[F.size(f"_s{i}").cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
                       F.sha2(_joined_spans(base), 256).alias("base_sha256"), _joined_spans(all_).alias("spans"))
