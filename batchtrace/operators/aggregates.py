"""Aggregations (A5-A14). All are hash aggregates with map-side partial combine;
no aggregate collects a table-sized group (arrays hold one recipe or one set's SKUs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from batchtrace.functions import codes as C
from batchtrace.operators.filters import active


def dashboard_kpis(ingredients: DataFrame, bags: DataFrame) -> DataFrame:
    """Active SKUs, active bags and total produced mass (0 when none) as one row.
    Two global aggregates (partial per task, one tiny final merge) cross-joined: each
    side is exactly one row, so the cross join is 1 x 1."""
    a = active(ingredients).agg(F.count(F.lit(1)).alias("sku_count"))
    b = active(bags).agg(F.count(F.lit(1)).alias("active_pellet_bags"),
                         F.coalesce(F.sum("bag_mass_kg"), F.lit(0.0)).alias("total_pellets_produced_kg"))
    return a.crossJoin(b)


def dependency_counts(weights: DataFrame, variants: DataFrame, locations: DataFrame) -> DataFrame:
    """A7 + U1 bulk form: per set, labelled counts of dependent rows (one row per
    (set_code, source) with count > 0)."""
    from batchtrace.operators.setops import union_labelled

    def per(df):
        return df.groupBy("set_code").agg(F.count(F.lit(1)).alias("n"))
    return union_labelled({"dry_weight_variants": per(weights), "batch_variants": per(variants),
                           "location_codes": per(locations)})


def active_role_count(roles: DataFrame) -> DataFrame:
    """Number of active roles (bootstrap check)."""
    return active(roles).agg(F.count(F.lit(1)).alias("active_roles"))


def distinct_formulations(forms: DataFrame) -> DataFrame:
    """Distinct code triples."""
    return forms.select("set_code", "weight_code", "batch_variant_code").distinct()


def distinct_formulations_from(primary: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """The code triples from the flat view when it is available, else from the
    batch-variant base table (same keys); the choice is made at plan time."""
    return distinct_formulations(primary if primary is not None else fallback)


def next_code_per_context(hows: DataFrame, context_col: str = "context_code",
                          code_col: str = "processing_code", start: int = 1) -> DataFrame:
    """A10: next two-letter code per context = max(start - 1, highest parsable code of the
    context's active rows) + 1, over all rows (unparsable codes skipped)."""
    g = active(hows).where(F.col(code_col).isNotNull()) \
        .groupBy(context_col).agg(F.max(C.code_to_int(code_col)).alias("max_code"))
    nxt = F.greatest(F.coalesce(F.col("max_code"), F.lit(start - 1)), F.lit(start - 1)) + 1
    return g.select(context_col, "max_code", nxt.alias("next_value"), C.int_to_code(nxt).alias("next_code"))


def next_suffix(hows: DataFrame) -> DataFrame:
    """Highest suffix text of the active hows (descending text order) and the code after
    it; 'AB' when there is none."""
    m = hows.where("is_active").agg(F.max("process_code_suffix").alias("max_suffix"))
    nxt = F.coalesce(C.code_to_int("max_suffix") + 1, F.lit(1))
    return m.select("max_suffix", C.int_to_code(nxt).alias("next_suffix"))


def query_cost_rollup(log: DataFrame) -> DataFrame:
    """Per request, sum of non-negative query durations and the query count."""
    return log.groupBy("request_id").agg(
        F.sum(F.greatest(F.col("elapsed_ms"), F.lit(0.0))).alias("query_ms"),
        F.count(F.lit(1)).alias("query_count"))


def sku_matrix(variants: DataFrame, keys: list[str], value_col: str, scope: list[str]) -> DataFrame:
    """A14 (bulk form): one row per variant with its cells aligned to the scope's
    column list. Columns = sorted distinct SKUs seen in the scope (e.g. one set),
    cell = the variant's value for that SKU or NULL.

    Returns ``keys + [columns array<string>, cells array<string>]``. The column list
    is gathered per scope (one set's SKUs, bounded by recipe size) and joined back:
    no driver-side pivot, no data-dependent schema."""
    e = variants.select(*scope, F.explode("items").alias("_it"))
    cols = e.groupBy(*scope).agg(F.sort_array(F.collect_set("_it.sku")).alias("columns"))
    # A repeated SKU in one variant shows its last value, like a display map.
    return variants.join(cols, scope).select(
        *keys, "columns",
        F.transform("columns", lambda s: F.try_element_at(F.filter("items", lambda x: x["sku"] == s), F.lit(-1))
                    [value_col].cast("string")).alias("cells"))


def matrix_columns(variants: DataFrame, scope: list[str]) -> DataFrame:
    """A14 column list: sorted distinct SKUs per scope (e.g. per set)."""
    e = variants.select(*scope, F.explode("items").alias("_it"))
    return e.groupBy(*scope).agg(F.sort_array(F.collect_set("_it.sku")).alias("columns"))


def sku_matrix_sparse(variants: DataFrame, keys: list[str], value_col: str, scope: list[str]) -> DataFrame:
    """A14 in sparse form for bulk use: per variant, only the filled cells as
    struct(col, value) where ``col`` is the 0-based index into the scope's column list
    (a repeated SKU keeps its last value). Column indexes come from an equi-join with a
    (scope, sku, index) table, so cost is linear in the item count however many columns
    a scope has; the dense matrix would grow with variants x columns."""
    cols = matrix_columns(variants, scope)
    index = cols.select(*scope, F.size("columns").alias("n_columns"),
                        F.posexplode("columns").alias("col", "sku"))
    n = F.size("items")
    last = F.filter("items", lambda x, i: (i == n - 1) | (F.get(F.col("items"), i + 1)["sku"] != x["sku"]))
    cells = variants.select(*keys, F.explode(last).alias("_it")).select(
        *keys, F.col("_it.sku").alias("sku"), F.col(f"_it.{value_col}").cast("string").alias("value"))
    j = cells.join(index, [*scope, "sku"])
    return j.groupBy(*keys, "n_columns").agg(
        F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "value"))).alias("cells"))
