"""Data-quality rules (Q1-Q9). Each returns a rejects frame ``(key..., rule, message)``
(some add ``column``/``value``); nothing raises mid-job. Vocabularies are fixed lists
of a few values, checked with ``isin`` (an InSet inside codegen), not with a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.functions.text import blank_to_null, repair_status
from batchtrace.sources import registries as R

# Limits for uploaded documents.
MAX_DOCUMENT_BYTES = 20 * 1024 * 1024
PDF_CONTENT_TYPE = "application/pdf"


def _explode_checks(df: DataFrame, keys: list[str], checks: list[tuple[Column, str, str]]) -> DataFrame:
    """One reject row per failed check (a row may fail several)."""
    arr = F.array(*[F.when(cond, F.struct(F.lit(rule).alias("rule"), F.lit(msg).alias("message")))
                    for cond, rule, msg in checks])
    return df.select(*keys, F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("_c")) \
             .select(*keys, "_c.rule", "_c.message")


_Q1 = [
    (lambda: ~F.coalesce(F.col("pack_size_unit").isin(*R.PACK_UNITS), F.lit(False)), "pack_size_unit",
     "pack_size_unit must be kg or L"),
    (lambda: ~F.coalesce(F.col("pack_size_value").between(*R.PACK_SIZE_RANGE), F.lit(False)), "pack_size_value",
     "pack_size_value must be between 1 and 1000"),
    (lambda: ~F.coalesce(F.col("format").isin(*R.FORMAT_VALUES), F.lit(False)), "format",
     "format must be one of " + ", ".join(R.FORMAT_VALUES)),
]


def ingredient_reason() -> Column:
    """Q1 as one column: struct(rule, message) of the first failed check, else NULL."""
    expr = None
    for cond, rule, msg in _Q1:
        val = F.struct(F.lit(rule).alias("rule"), F.lit(msg).alias("message"))
        expr = F.when(cond(), val) if expr is None else expr.when(cond(), val)
    return expr


def check_ingredients(df: DataFrame, key: str = "sku") -> DataFrame:
    """Q1: unit in {kg, L}; pack size 1..1000; format one of the six values."""
    return _explode_checks(df, [key], [(cond(), rule, msg) for cond, rule, msg in _Q1])


def rounded_sum(items, wt: str = "wt_percent") -> Column:
    """Sum of 2-dp rounded weights in an item array, exact decimal arithmetic."""
    zero = F.lit(0).cast("decimal(38,2)")
    return F.aggregate(items, zero, lambda acc, x: (acc + F.round(x[wt].cast("decimal(38,9)"), 2)).cast("decimal(38,2)"))


def weight_sum_is_100(items, wt: str = "wt_percent") -> Column:
    """Q2 (column form): rounded weights sum to exactly 100.00."""
    return rounded_sum(items, wt) == F.lit(100).cast("decimal(38,2)")


def check_weight_sum(items: DataFrame, keys: list[str], wt: str = "wt_percent") -> DataFrame:
    """Q2: per recipe (``keys``), the 2-dp rounded weights must sum to exactly 100.00."""
    g = items.groupBy(*keys).agg(F.sum(F.round(F.col(wt).cast("decimal(38,9)"), 2)).alias("total"))
    return g.where(F.col("total") != 100).select(
        *keys, F.col("total").cast("decimal(38,2)").alias("total"), F.lit("weight_sum").alias("rule"),
        F.lit("Weight percentages must sum to 100.00 after rounding").alias("message"))


def weight_total(items) -> Column:
    """Float total of wt_percent; NULL/blank counts as 0."""
    return F.aggregate(items, F.lit(0.0).cast("double"),
                       lambda acc, x: acc + F.coalesce(x["wt_percent"].cast("string").try_cast("double"), F.lit(0.0)))


def weight_sum_close(items, tol: float = 0.01) -> Column:
    """Q3: |total - 100| <= tol (0.01 library check; 0.00001 after 2-dp rounding in the UI)."""
    return F.abs(weight_total(items) - F.lit(100.0)) <= F.lit(tol)


def check_enums(df: DataFrame, keys: list[str], vocab: dict[str, list[str]], repair: bool = True) -> DataFrame:
    """Q4: each listed column, blank-normalised (and 'Recieved' repaired), must be NULL or in
    its vocabulary. One reject row per (row, column)."""
    bad, odd = [], F.lit(False)
    for c, values in vocab.items():
        v = repair_status(c) if repair else blank_to_null(c)
        # most values are in the list as they are; only the others are cleaned and looked up again
        raw = F.col(c).isNotNull() & ~F.col(c).isin(*values)
        odd = odd | raw
        bad.append(F.when(raw & v.isNotNull() & ~v.isin(*values), F.struct(F.lit(c).alias("column"), v.alias("value"))))
    out = df.where(odd).select(*keys, F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("_b"))
    return out.select(*keys, "_b.column", "_b.value", F.lit("enum").alias("rule"),
                      F.concat(F.lit("Invalid "), F.col("_b.column")).alias("message"))


def check_membership(req: DataFrame, array_col: str, ref: DataFrame, ref_col: str, prefix: str,
                     scope: list[str] | None = None, key: str = "request_id") -> DataFrame:
    """Values of ``array_col`` absent from ``ref`` (within ``scope``), reported per
    request as '<prefix>a, b' in request order (a value that is asked for again is listed again)."""
    scope = scope or []
    e = req.select(key, *scope, F.posexplode(array_col).alias("_pos", "_val"))
    r = ref.select(*scope, F.col(ref_col).alias("_val")).distinct()
    missing = e.join(r, [*scope, "_val"], "left_anti")
    g = missing.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_pos", "_val"))).alias("_m"))
    return g.select(key, F.lit("membership").alias("rule"),
                    F.concat(F.lit(prefix), F.array_join(F.transform("_m", lambda x: x["_val"]), ", ")).alias("message"))


def check_bounds(df: DataFrame, keys: list[str], bounds: dict[str, tuple]) -> DataFrame:
    """Q6: numeric bounds; ``None`` means open-ended. NULL values pass (optional fields)."""
    checks = []
    for c, (lo, hi) in bounds.items():
        cond = F.lit(False)
        if lo is not None:
            cond = cond | (F.col(c) < lo)
        if hi is not None:
            cond = cond | (F.col(c) > hi)
        checks.append((F.coalesce(cond, F.lit(False)), f"bounds_{c}",
                       f"{c} must be " + (f">= {lo}" if hi is None else f"between {lo} and {hi}")))
    return _explode_checks(df, keys, checks)


def check_nonempty_patch(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Q7: a patch with no editable field supplied is rejected."""
    empty = F.coalesce(*[blank_to_null(F.col(c).cast("string")) for c in cols]).isNull()
    return df.where(empty).select(*keys, F.lit("empty_patch").alias("rule"),
                                  F.lit("No editable fields provided").alias("message"))


def check_documents(manifest: DataFrame, targets: DataFrame, keys: list[str], pointer_col: str) -> DataFrame:
    """Q8: the target must exist; uploads must be of content type PDF, non-empty and at most
    20 MiB; replacing an existing document (target already has ``pointer_col``) needs
    ``confirm_replace``."""
    t = targets.select(*keys, F.col(pointer_col).isNotNull().alias("_has"))
    m = manifest.join(t, keys, "left")
    is_pdf = F.coalesce("content_type", F.lit("")) == PDF_CONTENT_TYPE
    return _explode_checks(m, [*keys, "filename"], [
        (F.col("_has").isNull(), "unknown_target", "Target not found"),
        (~is_pdf, "not_pdf", "Only PDF files are allowed"),
        (F.coalesce(F.col("size_bytes"), F.lit(0)) <= 0, "empty_file", "File is empty"),
        (F.coalesce(F.col("size_bytes"), F.lit(0)) > MAX_DOCUMENT_BYTES, "too_large", "File too large"),
        (F.coalesce(F.col("_has"), F.lit(False)) & ~F.coalesce(F.col("confirm_replace"), F.lit(False)),
         "replace_not_confirmed", "Replacing an existing document must be confirmed"),
    ])


def check_assignees(df: DataFrame, keys: list[str], cols: list[str], assignees: DataFrame) -> DataFrame:
    """Q9: every non-blank assignee must be an active assignee (one reject per field)."""
    active = assignees.where("is_active").select(F.col("email").alias("value")).distinct()
    named = F.array(*[F.struct(F.lit(c).alias("column"), blank_to_null(c).alias("value")) for c in cols])
    out = df.select(*keys, F.explode(F.filter(named, lambda x: x["value"].isNotNull())).alias("_a"))
    out = out.select(*keys, "_a.column", "_a.value")
    return out.join(active, "value", "left_anti").select(
        *keys, "column", "value", F.lit("assignee").alias("rule"),
        F.lit("Assignee must be an active assignee").alias("message"))


def check_unique(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """K12 ``assert_unique``: keys that occur more than once (one reject row per key)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        *keys, "n", F.lit("duplicate_key").alias("rule"),
        F.lit(f"{table}: key {', '.join(keys)} is not unique").alias("message"))
