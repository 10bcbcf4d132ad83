"""Joins (J1-J19) as DataFrame compositions.

Large-large joins are plain equi-joins: Catalyst picks sort-merge or shuffled hash
joins and AQE splits skewed partitions (``spark.sql.adaptive.skewJoin.enabled``).
Only registries whose size is fixed by the domain (partners, vocabularies, roles:
tens of rows) are broadcast explicitly; everything else is left to AQE, which
converts a join to broadcast only after measuring the real side size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.functions import codes as C
from batchtrace.functions.text import blank_to_null
from batchtrace.operators.filters import active

def overlay(custom: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Custom rows replace seed rows with the same key (keyed union)."""
    return custom.unionByName(seeds.join(custom.select(key), key, "left_anti"), allowMissingColumns=True)


def with_partner(df: DataFrame, registry: DataFrame, key: str = "partner_code") -> DataFrame:
    """Partner name (else 'Unknown') and machine (else '') from the partner registry
    (two-letter codes); Spark broadcasts it when it is under its own threshold."""
    r = registry.select(F.col("partner_code").alias(key), F.col("partner_name").alias("_pn"),
                        F.col("machine_specification").alias("_ms"))
    return (df.join(r, key, "left")
            .withColumn("partner_name", F.coalesce(F.nullif(F.col("_pn"), F.lit("")), F.lit("Unknown")))
            .withColumn("machine_specification", F.coalesce(F.nullif(F.col("_ms"), F.lit("")), F.lit("")))
            .drop("_pn", "_ms"))


def context_labels(ctx: DataFrame, partners: DataFrame) -> DataFrame:
    """Context x partner (left join) with the display label
    'partner name (else partner code, else '') - machine code (else '')'."""
    p = partners.select("partner_code", F.col("partner_name").alias("_pn"))
    j = ctx.join(p, "partner_code", "left")
    label = F.concat(F.coalesce(F.col("_pn"), F.col("partner_code"), F.lit("")), F.lit(" - "),
                     F.coalesce(F.col("machine_code"), F.lit("")))
    return j.withColumn("conversion_partner", label).withColumnRenamed("_pn", "partner_name")


def location_tokens(df: DataFrame, col: str = "location_code") -> DataFrame:
    """Derived join keys: the first three tokens of a location code (NULL if missing)."""
    return df.withColumn("_set", C.token(col, 0)).withColumn("_weight", C.token(col, 1)) \
             .withColumn("_variant", C.token(col, 2))


def hows_to_formulations(hows: DataFrame, forms: DataFrame) -> DataFrame:
    """Equi-join on derived tokens of ``location_code`` = formulation codes.
    A location code with fewer than three tokens joins nothing (NULL keys)."""
    h = location_tokens(hows)
    f = forms.withColumnRenamed("set_code", "_set").withColumnRenamed("weight_code", "_weight") \
             .withColumnRenamed("batch_variant_code", "_variant")
    j = h.join(f, ["_set", "_weight", "_variant"])
    return j.withColumnRenamed("_set", "set_code").withColumnRenamed("_weight", "weight_code") \
            .withColumnRenamed("_variant", "batch_variant_code")


def bags_to_formulations(bags: DataFrame, hows: DataFrame, forms: DataFrame, active_how: bool) -> DataFrame:
    """J6 chain: bag -> compounding how (by processing code) -> formulation (by tokens).
    ``active_how`` keeps only active hows (bag detail); the SKU summary does not (K8)."""
    h = active(hows) if active_how else hows
    h = h.select(F.col("processing_code").alias("compounding_how_code"), "location_code")
    return hows_to_formulations(bags.join(h, "compounding_how_code"), forms)


def using_sku(items: DataFrame, skus: DataFrame, ignore_case: bool = False) -> DataFrame:
    """J7/J8 bulk form: SKU x formulation whose items contain it, from the item table itself; the
    requested SKU is ``requested_sku``. A filter on the SKUs reaches both scans."""
    fold = F.lower if ignore_case else F.col
    want = skus.select(F.col("sku").alias("requested_sku"), fold("sku").alias("_k")).distinct()
    keys = ["set_code", "weight_code", "batch_variant_code"]
    # dealt out by formulation once: equal rows are dropped there, and joins on its codes keep that partitioning
    used = items.select(*keys, fold("sku").alias("_k")).join(want, "_k").select(*keys, "requested_sku")
    return used.repartition(*keys).distinct()


def sets_matching(sets: DataFrame, q: str | None) -> DataFrame:
    """Sets whose code matches, or any SKU of which contains q (case-insensitive)."""
    if not q:
        return sets
    ql = q.lower()
    return sets.where(F.contains(F.lower("set_code"), F.lit(ql))
                      | F.exists("sku_list", lambda x: F.contains(F.lower(x), F.lit(ql))))


def using_batch(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """J10 bulk form: (sku, batch) pair x formulation whose items contain the pair, from the item
    table itself (equi-join on both fields)."""
    have = items.select("set_code", "weight_code", "batch_variant_code", "sku", "ingredient_batch_code").distinct()
    return pairs.select("sku", "ingredient_batch_code").distinct().join(have, ["sku", "ingredient_batch_code"])


def existing_batches(pairs: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trim requested (sku, batch) pairs, reject null/blank parts, and return the
    intersection with stored batches plus a rejects frame."""
    t = pairs.select("*", blank_to_null("sku").alias("_s"), blank_to_null("ingredient_batch_code").alias("_b"))
    bad = t.where(F.col("_s").isNull() | F.col("_b").isNull()) \
           .select(*pairs.columns, F.lit("malformed_pair").alias("rule"),
                   F.lit("sku and ingredient_batch_code are required").alias("message"))
    ok = t.where(F.col("_s").isNotNull() & F.col("_b").isNotNull()) \
          .select(F.col("_s").alias("sku"), F.col("_b").alias("ingredient_batch_code")).distinct()
    found = ok.join(batches.select("sku", "ingredient_batch_code"), ["sku", "ingredient_batch_code"], "left_semi")
    return found, bad


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """NOT EXISTS guarded insert (anti join)."""
    return new.join(existing.select(*keys), keys, "left_anti")


def split_existing(requests: DataFrame, ref: DataFrame, keys: list[str],
                   ref_keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Bulk existence probe -> (found, missing)."""
    r = ref.select(*[F.col(a).alias(b) for a, b in zip(ref_keys or keys, keys)]).distinct()
    return requests.join(r, keys, "left_semi"), requests.join(r, keys, "left_anti")


#: Bits of ``split_by_keys``' filter: its broadcast has at most BITS / 64 rows of two longs, however many keys there are.
BITS = 1 << 27
_HASHED = ("string", "tinyint", "smallint", "int", "bigint")


def split_by_keys(rows: DataFrame, named: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key may be in ``named``, rows whose key is not). A broadcast bit per key hash tells, so only
    the former need a shuffle; the more keys, the more of the others are among them. Keys of which equal
    values may differ in their hash are not told apart: then all rows come back, and None."""
    kind = lambda df, k: df.schema[k].dataType.simpleString()
    if any(kind(rows, k) != kind(named, k) or kind(rows, k) not in _HASHED for k in keys):
        return rows, None
    bit = F.xxhash64(*keys).bitwiseAND(F.lit(BITS - 1))
    bits = named.select(bit.alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_bit & 63 as int))")).alias("_mask"))
    told = rows.withColumn("_bit", bit)
    told = told.join(F.broadcast(bits), F.shiftright("_bit", 6) == F.col("_word"), "left")  # a bounded size
    found = F.expr("(shiftrightunsigned(coalesce(_mask, 0L), cast(_bit & 63 as int)) & 1L) = 1L")
    return tuple(told.where(c).select(*[F.col(f"`{c}`") for c in rows.columns]) for c in (found, ~found))


def semi_join(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``rows LEFT SEMI JOIN named``, of which only rows whose key may be in ``named`` are shuffled."""
    return split_by_keys(rows, named, keys)[0].join(named, keys, "left_semi")


def anti_join(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """``rows LEFT ANTI JOIN named``, of which only rows whose key may be in ``named`` are shuffled."""
    near, far = split_by_keys(rows, named, keys)
    near = near.join(named, keys, "left_anti")
    return near if far is None else near.unionByName(far)


def skew_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str], right_keys: DataFrame | None = None) -> DataFrame:
    """``left LEFT JOIN right`` when one left key may match a huge number of right rows.

    AQE can split a skewed partition of an outer join only on its preserved side, so the
    hot right side of a left join would stay in one task. Written as an inner join (either
    side splittable) plus the unmatched left rows (anti join against the distinct right
    keys, which combine map-side), the result is the same rows and nothing stays hot.
    ``right_keys`` names a cheaper source of the keys of ``right`` (which is then read once)."""
    matched = right.join(left, keys, "inner")
    have = (right if right_keys is None else right_keys).select(*keys).distinct()
    unmatched = left.join(have, keys, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)
