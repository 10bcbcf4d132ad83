"""F16: SHA-256 content hashes of recipes, computed on array columns (no UDF).

Canonical texts (fixed by the data contract):
  set      ``sku1|sku2|...``                 SKUs sorted, duplicates kept
  weights  ``sku1=12.50|sku2=87.50``         sorted by SKU, weight with 2 decimals
  batches  ``sku1=BATCH_A|sku2=BATCH_B``     sorted by SKU
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from batchtrace.functions._util import col


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def set_canonical(skus) -> Column:
    return F.array_join(F.sort_array(col(skus)), "|")


def hash_set(skus) -> Column:
    """Hash of an array<string> of SKUs."""
    return _sha(set_canonical(skus))


def weights_canonical(items, sku: str = "sku", wt: str = "wt_percent") -> Column:
    srt = F.array_sort(F.transform(col(items), lambda x: F.struct(x[sku].alias("k"), x[wt].alias("v"))))
    return F.array_join(F.transform(srt, lambda x: F.concat(
        x["k"], F.lit("="), x["v"].cast("decimal(38,2)").cast("string"))), "|")


def hash_weights(items, sku: str = "sku", wt: str = "wt_percent") -> Column:
    """Hash of an array<struct<sku, wt_percent>> (weights already rounded to 2 dp)."""
    return _sha(weights_canonical(items, sku, wt))


def batches_canonical(items, sku: str = "sku", batch: str = "ingredient_batch_code") -> Column:
    srt = F.array_sort(F.transform(col(items), lambda x: F.struct(x[sku].alias("k"), x[batch].alias("v"))))
    return F.array_join(F.transform(srt, lambda x: F.concat(x["k"], F.lit("="), x["v"])), "|")


def hash_batches(items, sku: str = "sku", batch: str = "ingredient_batch_code") -> Column:
    """Hash of an array<struct<sku, ingredient_batch_code>>."""
    return _sha(batches_canonical(items, sku, batch))
