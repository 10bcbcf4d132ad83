"""A6, A7, A11 kept by deltas: signed sums of what a commit adds and takes away, beside its rows.

Each commit writes a few delta rows (metric, scope, value) into the table ``metric_deltas``; totals
are sums over those, so they cost the number of commits and scopes, not a scan of bags and variants.
A change of a row is its old image taken away and its new one added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from batchtrace.functions import codes as C

TABLE = "metric_deltas"
DELTAS = T.StructType([T.StructField("metric", T.StringType()), T.StructField("scope", T.StringType()),
                       T.StructField("value", T.DecimalType(38, 9))])

_ACTIVE = "coalesce(is_active, false)"
#: Table -> (metric, scope, value) of one row; the value is a SQL expression, 0 where the row does not count.
METRICS: dict[str, list[tuple[str, str, str]]] = {
    "ingredients": [("sku_count", "''", f"cast({_ACTIVE} as int)")],
    "pellet_bags": [("active_pellet_bags", "''", f"cast({_ACTIVE} as int)"),
                    ("total_pellets_produced_kg", "''", f"case when {_ACTIVE} then coalesce(bag_mass_kg, 0) else 0 end")],
    "dry_weight_variants": [("dry_weight_variants", "set_code", "1")],
    "batch_variants": [("batch_variants", "set_code", "1")],
    "location_codes": [("location_codes", "set_code", "1")],
    # how often a suffix is in use, so that the highest one is known after deletions too
    "compounding_how": [("process_code_suffix", "process_code_suffix", f"cast({_ACTIVE} as int)")],
}
DEPENDANTS = ["dry_weight_variants", "batch_variants", "location_codes"]


def deltas(name: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Delta rows of a change to table ``name``: one row per metric and scope whose sum changed."""
    def signed(rows: DataFrame, sign: int) -> DataFrame:
        one = [F.struct(F.lit(m).alias("metric"), F.expr(s).cast("string").alias("scope"),
                        (F.expr(v).cast("decimal(28,9)") * sign).cast("decimal(38,9)").alias("value")) for m, s, v in METRICS[name]]
        return rows.select(F.explode(F.array(*one)).alias("d")).select("d.*")
    parts = [signed(r, s) for r, s in ((added, 1), (removed, -1)) if r is not None]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("metric", "scope").agg(F.sum("value").cast("decimal(38,9)").alias("value")).where("value <> 0")


def totals(posted: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Sum per (metric, scope) over all commits, of those that are not 0."""
    rows = posted if metrics is None else posted.where(F.col("metric").isin(metrics))
    return rows.groupBy("metric", "scope").agg(F.sum("value").alias("value")).where("value <> 0")


def dashboard_kpis(posted: DataFrame) -> DataFrame:
    """A6 from the deltas: the row that ``aggregates.dashboard_kpis`` gives, without reading its tables."""
    def metric(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("metric") == name, F.col("value"))), F.lit(0))
    names = ["sku_count", "active_pellet_bags", "total_pellets_produced_kg"]
    kinds = ["long", "long", "double"]
    return posted.where(F.col("metric").isin(names)).agg(*[metric(n).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)])


def dependency_counts(posted: DataFrame) -> DataFrame:
    """A7 from the deltas: (set_code, source, n)."""
    return totals(posted, DEPENDANTS).select(F.col("scope").alias("set_code"), F.col("value").cast("long").alias("n"),
                                             F.col("metric").alias("source"))


def next_suffix(posted: DataFrame) -> DataFrame:
    """A11 from the deltas: highest suffix in use and the code after it."""
    used = totals(posted, ["process_code_suffix"]).where("value > 0")
    m = used.agg(F.max("scope").alias("max_suffix"))
    return m.select("max_suffix", C.int_to_code(F.coalesce(C.code_to_int("max_suffix") + 1, F.lit(1))).alias("next_suffix"))
