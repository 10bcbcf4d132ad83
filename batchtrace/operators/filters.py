"""Projections, filters and predicates.

All predicates are Column expressions on the scanned frame, so Catalyst pushes the
simple ones (equality, IS NOT NULL, boolean flags) into the Parquet scan; list
membership uses semi joins instead of huge IN lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.functions.text import blank_to_null, repair_status
from batchtrace.sources import registries as R

# Fixed column lists per listing.
LISTING_COLS = {
    "pellet_bags": [
        "pellet_bag_id", "pellet_bag_code", "pellet_bag_code_tokens", "compounding_how_code", "product_type",
        "sequence_number", "bag_mass_kg", "remaining_mass_kg", "short_moisture_percent", "purpose",
        "reference_sample_taken", "qc_status", "long_moisture_status", "density_status",
        "injection_moulding_status", "film_forming_status", "long_moisture_assignee_email",
        "density_assignee_email", "injection_moulding_assignee_email", "film_forming_assignee_email", "notes",
        "customer", "created_at", "updated_at", "created_by", "updated_by"],
    "compounding_how": [
        "processing_code", "location_code", "process_code_suffix", "failure_mode", "machine_setup_url",
        "processed_data_url", "notes", "created_at", "updated_at", "created_by", "updated_by"],
    "location_codes": [
        "location_id", "set_code", "weight_code", "batch_variant_code", "partner_code", "production_date",
        "created_at", "created_by"],
    "conversion1_how": [
        "conversion1_how_code", "context_code", "process_code", "processing_code", "failure_mode",
        "machine_setup_url", "processed_data_url", "created_at", "created_by", "updated_at", "updated_by"],
}


def project(df: DataFrame, listing: str) -> DataFrame:
    """Select the fixed column list of a listing."""
    return df.select(*LISTING_COLS[listing])


def filter_eq(df: DataFrame, values: dict) -> DataFrame:
    """AND of ``col = value`` for supplied (non-None) keys only; no predicate if empty."""
    preds = [F.col(c) == F.lit(v) for c, v in values.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def like_any(cols: list[str], q: str | None) -> Column | None:
    """P3 predicate: lower(col) LIKE '%q%' on any column. ``%``/``_`` in q stay wildcards."""
    if not q:
        return None
    pat = f"%{q.lower()}%"
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).like(pat), F.lit(False)) for c in cols])


def search_like(df: DataFrame, cols: list[str], q: str | None) -> DataFrame:
    """Case-insensitive LIKE over any of several columns."""
    p = like_any(cols, q)
    return df if p is None else df.where(p)


def contains_ci(c, q: str) -> Column:
    """P4 predicate: case-insensitive substring (CONTAINS_SUBSTR on ASCII text)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.contains(F.lower(c), F.lit(q.lower())), F.lit(False))


def search_contains(df: DataFrame, col: str, q: str | None) -> DataFrame:
    """CONTAINS_SUBSTR-style filter; no predicate when q is empty."""
    return df.where(contains_ci(col, q)) if q else df


def active(df: DataFrame) -> DataFrame:
    """P5: soft-delete filter."""
    return df.where(F.col("is_active"))


def not_archived(df: DataFrame, include_archived: bool = False) -> DataFrame:
    """NULL counts as not archived; ``include_archived`` disables the filter."""
    return df if include_archived else df.where(~F.coalesce(F.col("archived"), F.lit(False)))


def assigned_to(status_col: str) -> Column:
    """The stream's own assignee, falling back to the creator (QC uses the creator)."""
    a = R.STATUS_ASSIGNEE[status_col]
    return F.coalesce(F.col(a), F.col("created_by")) if a else F.col("created_by")


def status_column(name: str, editable: bool = False) -> str:
    """Whitelisted dynamic status column; anything else raises at plan time."""
    allowed = R.EDITABLE_STATUS_COLUMNS if editable else list(R.STATUS_VOCAB)
    if name not in allowed:
        raise ValueError(f"Invalid status column: {name}")
    return name


def meaningful_status(c: str) -> Column:
    """P7 predicate: non-null, non-blank, not a terminal/unrequested value."""
    t = F.lower(F.trim(F.col(c)))
    return F.col(c).isNotNull() & (F.trim(F.col(c)) != "") & ~t.isin(*R.QUEUE_EXCLUDED_STATUSES)


def status_queue(bags: DataFrame, status_col: str) -> DataFrame:
    """P7 + P11 + F20: open work items of one status stream (unordered, unlimited).
    Ordering and the queue size (O3) are applied by the caller."""
    c = status_column(status_col)
    return active(bags).where(meaningful_status(c)).select(
        "pellet_bag_id", "pellet_bag_code", F.col(c).alias("status_value"),
        repair_status(c).alias("status_label"), assigned_to(c).alias("assigned_to"), "updated_at", "created_at")


def duplicate_keys(with_pack_size: bool = True) -> list[str]:
    """Product identity attributes (spec_grade compared null-safely)."""
    keys = ["category_code", "trade_name_inci", "supplier", "spec_grade", "format", "pack_size_unit"]
    return keys + ["pack_size_value"] if with_pack_size else keys


def null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def find_duplicates(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that match an existing row on all keys (NULL equals NULL).
    Spark plans the ``<=>`` conditions as equi-join keys, so this stays a hash or
    sort-merge join (no nested loop)."""
    e = existing.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "sku", "seq")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys])
    return new.join(e, cond, "inner")


def where_in(df: DataFrame, col: str, values: DataFrame, values_col: str | None = None) -> DataFrame:
    """Membership in a (possibly large) list given as a frame -> left semi join."""
    v = values.select(F.col(values_col or col).alias(col)).distinct()
    return df.join(v, col, "left_semi")


def distinct_nonblank(df: DataFrame, col: str, trim_first: bool = False) -> DataFrame:
    """P10: distinct non-blank values for a dropdown, trimmed. As in the reference, DISTINCT
    runs on the stored text and trimming follows, so untrimmed twins stay separate rows;
    ``trim_first`` collapses them instead."""
    nonblank = df.where(F.trim(F.col(col)) != "")
    if trim_first:
        return nonblank.select(F.trim(F.col(col)).alias(col)).distinct()
    return nonblank.select(col).distinct().select(F.trim(F.col(col)).alias(col))


def lookup(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """P13 bulk form: rows whose key is requested (semi join); one row per key is
    guaranteed separately by ``paging.first_per_key``."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")
