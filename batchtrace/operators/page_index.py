"""O2 for any page by a sparse key index: every so many rows of a listing's order, the sort key.

The index of a listing has one row per ``every`` rows; page n is cut from the one or two key ranges
that hold it, so page 1,000 sorts no more rows than page 1. The range's bounds on the leading sort
column reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.operators import paging as O
from batchtrace.operators.numbering import sequence_within

EVERY = 1000


def build(df: DataFrame, spec: list[tuple[str, bool]], every: int = EVERY) -> DataFrame:
    """(rank, the sort columns) of each ``every``-th row in listing order, and a last row with the
    total as rank and NULL keys. One shuffle of the sort columns; ``spec`` has to order the rows totally."""
    keys = [c for c, _ in spec]
    ranked = sequence_within(df.select(*keys), [], O.order_cols(spec), out="rank")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    end = df.agg(F.count(F.lit(1)).alias("rank")).select("rank", *[F.lit(None).cast(kinds[k]).alias(k) for k in keys], F.lit(True).alias("end"))
    return ranked.where(F.col("rank") % every == 0).select("rank", *keys, F.lit(False).alias("end")).unionByName(end)


def _from(spec: list[tuple[str, bool]], key: dict) -> Column:
    """Rows at or after ``key`` in listing order (NULL last where descending, first where ascending)."""
    def equal(c: str) -> Column:
        return F.col(c).isNull() if key[c] is None else F.col(c) == F.lit(key[c])

    def after(c: str, desc: bool) -> Column:
        if key[c] is None:
            return F.lit(False) if desc else F.col(c).isNotNull()
        return (F.col(c) < F.lit(key[c])) | F.col(c).isNull() if desc else F.col(c) > F.lit(key[c])

    terms = [reduce(lambda a, b: a & b, [*[equal(p) for p, _ in spec[:i]], after(c, d)]) for i, (c, d) in enumerate(spec)]
    same = reduce(lambda a, b: a & b, [equal(c) for c, _ in spec])
    lead, desc = spec[0]
    bound = F.lit(True)
    if key[lead] is not None:  # implied by the rest; a bound that the scan can use
        bound = (F.col(lead) <= F.lit(key[lead])) | F.col(lead).isNull() if desc else F.col(lead) >= F.lit(key[lead])
    return bound & F.coalesce(reduce(lambda a, b: a | b, [*terms, same]), F.lit(False))


def page(df: DataFrame, index: DataFrame, spec: list[tuple[str, bool]], page_no: int = 1, size: int | None = None) -> tuple[DataFrame, int]:
    """(rows of the page, total); the index has to be that of ``df``'s rows."""
    page_no, size = O.clamp_page(page_no, size)
    first = (page_no - 1) * size
    # at most the entry before the page, those within it, and one after it: size / every + 3 rows
    low = index.where(~F.col("end") & (F.col("rank") <= first)).orderBy(F.desc("rank")).limit(1)
    high = index.where(~F.col("end") & (F.col("rank") >= first + size)).orderBy("rank").limit(1)
    got = low.unionByName(high).unionByName(index.where("end")).collect()
    total = next(r["rank"] for r in got if r["end"])
    start = next((r.asDict() for r in got if not r["end"] and r["rank"] <= first), None)
    stop = next((r.asDict() for r in got if not r["end"] and r["rank"] >= first + size), None)
    if start is None or first >= total:
        return df.limit(0), total
    rows = df.where(_from(spec, start))
    if stop is not None:
        rows = rows.where(~_from(spec, stop))
    return rows.orderBy(*O.order_cols(spec)).offset(first - start["rank"]).limit(size), total
