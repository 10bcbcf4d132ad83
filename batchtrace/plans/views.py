"""Derived recipe views (L1-L4 with J1-J3, A1-A4, N1-N3, J17).

Each view joins a header table to its item table and groups by the header columns,
exactly like the view definitions: headers without items vanish (inner join), and
items are ordered with the SKU first so ``sort_array`` gives SKU order. The join and
the grouping share one hash partitioning (the grouping keys contain the join keys),
so each view costs one shuffle per input and no extra exchange for the aggregate.

Arrays stay small: they hold one recipe (tens of SKUs), never a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from batchtrace.functions import codes as C
from batchtrace.functions.text import array_size


def ordered_items(items) -> F.Column:
    """An item array in order (struct fields compared left to right, SKU first)."""
    return F.sort_array(items)


def _sorted_items(*fields: str):
    """sort_array(collect_list(struct(fields))): total order, first field first."""
    return ordered_items(F.collect_list(F.struct(*fields)))


def sets_view(sets: DataFrame, items: DataFrame) -> DataFrame:
    """L1 base (v_sets): one row per set header with its sorted SKU list (duplicates kept)."""
    head = ["set_code", "set_hash", "created_at", "created_by", "notes", "material_workstream"]
    return (sets.select(*head)
            .join(items.select("set_code", "sku"), "set_code")
            .groupBy(*head)
            .agg(F.sort_array(F.collect_list("sku")).alias("sku_list")))


def weight_variants(headers: DataFrame, items: DataFrame) -> DataFrame:
    """L2 base (v_weight_variants): items = [struct(sku, wt_percent)] ordered by SKU."""
    keys = ["set_code", "weight_code"]
    head = keys + ["weight_hash", "created_at", "created_by"]
    return (headers.select(*head)
            .join(items.select(*keys, "sku", "wt_percent"), keys)
            .groupBy(*head)
            .agg(_sorted_items("sku", "wt_percent").alias("items")))


def weight_items_by_key(headers: DataFrame, items: DataFrame) -> DataFrame:
    """Weight items per (set_code, weight_code) that have a header, grouped by exactly the
    key L4 joins on. Because the result is unique on the join key, Catalyst removes the
    whole weight branch from any L4 query that does not read the weights. Equal to the
    view's items whenever (set, weight) headers are unique (K12, checked by
    ``quality.check_unique``); duplicate headers would only repeat identical rows in the view."""
    keys = ["set_code", "weight_code"]
    have = headers.select(*keys).distinct()
    return (items.select(*keys, "sku", "wt_percent").join(have, keys, "left_semi")
            .groupBy(*keys).agg(_sorted_items("sku", "wt_percent").alias("items")))


def batch_variants(headers: DataFrame, items: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """L3 base (v_batch_variants): items = [struct(sku, ingredient_batch_code)] ordered by SKU.
    ``created_by`` is a group key and also the any-value output (A4). ``more`` names columns of
    ``headers`` to keep, which depend on its own columns."""
    keys = ["set_code", "weight_code", "batch_variant_code"]
    head = keys + ["batch_hash", "created_at", "created_by", *more]
    return (headers.select(*head)
            .join(items.select(*keys, "sku", "ingredient_batch_code"), keys)
            .groupBy(*head)
            .agg(_sorted_items("sku", "ingredient_batch_code").alias("items")))


def sku_list(items) -> F.Column:
    """SKUs of an ordered struct array."""
    return F.transform(items, lambda x: x["sku"])


def weight_for(weight_items, sku) -> F.Column:
    """First wt_percent in ``weight_items`` whose sku equals ``sku``, else NULL."""
    return F.get(F.filter(weight_items, lambda x: x["sku"] == sku), 0)["wt_percent"]


def aligned_weights(skus, weight_items) -> F.Column:
    """One struct(sku, wt_percent) per SKU of the formulation, in formulation order."""
    return F.transform(skus, lambda s: F.struct(s.alias("sku"), weight_for(weight_items, s).alias("wt_percent")))


def formulations_flat(bv: DataFrame, wv: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """L4 (v_formulations_flat): batch variants left-joined to their dry weights.

    ``bv`` is :func:`batch_variants`; ``wv`` is :func:`weight_items_by_key` (or
    :func:`weight_variants`): only its (set_code, weight_code, items) are read.
    A formulation without a weight variant keeps NULL weights. ``more`` columns of ``bv`` are kept."""
    b = bv.select("set_code", "weight_code", "batch_variant_code", "created_at", "created_by", *more,
                  sku_list("items").alias("sku_list"),
                  F.col("items").alias("batch_items"))
    w = wv.select("set_code", "weight_code", F.col("items").alias("_w_items"))
    j = b.join(w, ["set_code", "weight_code"], "left")
    return j.select(
        "set_code", "weight_code", "batch_variant_code",
        C.base_code("set_code", "weight_code", "batch_variant_code").alias("base_code"),
        "created_at", "created_by", "sku_list",
        array_size("sku_list").cast("int").alias("sku_count"),
        "batch_items",
        aligned_weights(F.col("sku_list"), F.col("_w_items")).alias("dry_weight_items"), *more)


def formulations(t, more: tuple[str, ...] = ()) -> DataFrame:
    """L4 over a table set ``t`` (anything indexable by table name), with ``more`` columns of its
    batch variant headers."""
    return formulations_flat(batch_variants(t["batch_variants"], t["batch_variant_items"], more),
                             weight_items_by_key(t["dry_weight_variants"], t["dry_weight_items"]), more)


def sets(t) -> DataFrame:
    return sets_view(t["ingredient_sets"], t["ingredient_set_items"])


def weights(t) -> DataFrame:
    return weight_variants(t["dry_weight_variants"], t["dry_weight_items"])


def variants(t) -> DataFrame:
    return batch_variants(t["batch_variants"], t["batch_variant_items"])


# ---- text renderings of the nested columns (stable across engines) -------------------

def skus_text(c) -> F.Column:
    return F.array_join(c, ",")


def pairs_text(items, a: str, b: str) -> F.Column:
    """'sku=value|sku=value'; a NULL value renders as an empty string."""
    return F.array_join(F.transform(items, lambda x: F.concat(x[a], F.lit("="),
                                                              F.coalesce(x[b].cast("string"), F.lit("")))), "|")
