"""Sorts, limits, top-k and paging.

``page`` is an offset page (sort + OFFSET + LIMIT). Spark plans ``orderBy().offset().limit()``
as a TakeOrderedAndProject with offset: each task keeps only its local top (offset + size)
rows, so the shuffle carries (offset + size) x tasks rows, not the table. Deep pages grow
with the offset; ``page_after`` (keyset paging) keeps every page as cheap as the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from batchtrace.sources import registries as R

# O1: listing sort orders with their tie-breakers (the last keys make the order total).
SORT_SPECS: dict[str, list[tuple[str, bool]]] = {
    # (column, descending)
    "ingredients": [("seq", False), ("category_code", False), ("pack_size_value", False), ("sku", False)],
    "batches": [("created_at", False), ("sku", False), ("ingredient_batch_code", False)],
    "sets": [("created_at", False), ("set_code", False)],
    "formulations": [("created_at", True), ("set_code", True), ("weight_code", True), ("batch_variant_code", True)],
    "location_codes": [("created_at", True), ("location_id", True)],
    "contexts": [("created_at", True), ("context_code", True)],
    "conversion_hows": [("created_at", True), ("conversion1_how_code", True)],
    "products": [("created_at", True), ("product_suffix", True), ("product_code", True)],
    "compounding_how": [("created_at", True), ("processing_code", True)],
    "pellet_bags": [("created_at", True), ("sequence_number", True), ("pellet_bag_code", True)],
}


def order_cols(spec: list[tuple[str, bool]]) -> list[Column]:
    return [(F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first()) for c, d in spec]


def sort_listing(df: DataFrame, name: str) -> DataFrame:
    """O1: sort a listing by its fixed multi-key order."""
    return df.orderBy(*order_cols(SORT_SPECS[name]))


def clamp_page(page: int | None, size: int | None) -> tuple[int, int]:
    """Page >= 1; size defaults to 50 and is clamped to 1..200."""
    page = max(int(page or 1), 1)
    size = R.DEFAULT_PAGE_SIZE if size is None else min(max(int(size), 1), R.MAX_PAGE_SIZE)
    return page, size


def page(df: DataFrame, sort: str | list[tuple[str, bool]], page_no: int = 1,
         size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """O2: 1-indexed offset page plus a one-row total frame (A5)."""
    page_no, size = clamp_page(page_no, size)
    spec = SORT_SPECS[sort] if isinstance(sort, str) else sort
    rows = df.orderBy(*order_cols(spec)).offset((page_no - 1) * size).limit(size)
    return rows, total(df)


def page_after(df: DataFrame, sort: str | list[tuple[str, bool]], last_key: dict | None,
               size: int | None = None) -> DataFrame:
    """O2 keyset variant: rows strictly after ``last_key`` in the listing order.

    The predicate is a lexicographic comparison on the sort columns, which the scan
    can partly push down; cost does not grow with the page number."""
    _, size = clamp_page(1, size)
    spec = SORT_SPECS[sort] if isinstance(sort, str) else sort
    return after(df, spec, last_key).orderBy(*order_cols(spec)).limit(size)


def after(df: DataFrame, spec: list[tuple[str, bool]], last_key: dict | None) -> DataFrame:
    """Rows strictly after ``last_key`` in listing order (None: all)."""
    if not last_key:
        return df
    terms = []
    for i, (c, d) in enumerate(spec):
        eq = [F.col(p) == F.lit(last_key[p]) for p, _ in spec[:i]]
        cmp = F.col(c) < F.lit(last_key[c]) if d else F.col(c) > F.lit(last_key[c])
        terms.append(reduce(lambda a, b: a & b, eq + [cmp]))
    return df.where(reduce(lambda a, b: a | b, terms))


def total(df: DataFrame) -> DataFrame:
    """A5: filtered total for paging."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def page_flags(total_df: DataFrame, page_no: int, size: int) -> DataFrame:
    """has_prev / has_next next to the total."""
    return total_df.select("total", F.lit(page_no > 1).alias("has_prev"),
                           (F.lit(page_no * size) < F.col("total")).alias("has_next"),
                           F.lit(page_no).alias("page"), F.lit(size).alias("page_size"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """O3: top-N by an ordering (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def first_per_key(df: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """First row per key by ``order`` ([(column, descending)]).

    A row_number window cut at 1: Spark also cuts inside each task before the shuffle, so a key
    holding a third of the table sends one row a task. Ties are broken by the remaining row fields (in
    the direction of the last order column), so the result is deterministic. ``first_ids`` is the
    cheaper form for rows that have an id."""
    rest = [(c, order[-1][1] if order else False) for c in df.columns if c not in keys and c not in {o for o, _ in order}]
    w = Window.partitionBy(*keys).orderBy(*order_cols([*order, *rest]))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def order_key(df: DataFrame, order: list[str]) -> Column:
    """Ascending ``order`` columns as one value. Two columns, a time and a whole number, fit into one
    decimal, which a hash aggregate can keep; anything else is a struct. NULL comes first."""
    kinds = [df.schema[c].dataType.simpleString() for c in order]
    if len(order) == 2 and kinds[0] in ("timestamp", "timestamp_ntz") and kinds[1] in ("tinyint", "smallint", "int", "bigint"):
        whole = "decimal(38,0)"
        micros = F.coalesce(F.unix_micros(F.col(order[0]).cast("timestamp")), F.lit(-(1 << 62))).cast(whole)
        number = F.coalesce(F.col(order[1]).cast("long"), F.lit(-(1 << 63))).cast(whole)
        # more than the 2^64 numbers that one microsecond may have; 2^62 times that is below 10^38
        return (micros * F.lit(str(2 * 10 ** 19)).cast("decimal(20,0)")).cast(whole) + number
    return F.struct(*order)


def first_ids(df: DataFrame, keys: list[str], order: list[str], row_id: str = "_rid") -> DataFrame:
    """O5 by key reduction: per key the first ``order`` value (``_first``) and the id of its row
    (``_first_rid``); with ``order_key``s of a fixed width a hash aggregate, partial in each task. No row
    is carried: rows compare their id with that of their key."""
    return df.groupBy(*keys).agg(F.min(order_key(df, order)).alias("_first"),
                                 F.min_by(row_id, order_key(df, order)).alias("_first_rid"))
