"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the
projected test tables. Oracle SQL for each lives in ``batchtrace.plans.oracle``.

Nested outputs are rendered as text columns (``*_text``) so results compare across
engines; the library functions themselves return the nested form.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchtrace.functions import codes as C
from batchtrace.functions import hashing as H
from batchtrace.functions import text as TX
from batchtrace.functions.udfs import nfkc_casefold, round_weight_exact
from batchtrace.operators import aggregates as A, paging as O
from batchtrace.operators import changes as CH, policy as X, quality as Q
from batchtrace.operators import filters as P, joins as J
from batchtrace.operators import registry as M
from batchtrace.operators.numbering import sequence_within
from batchtrace.plans import lineage as LN, views as V
from batchtrace.session import checkpoint_dir, ship
from batchtrace.sources import registries as R
from batchtrace.sources import schemas as S
from batchtrace.sources.commits import APPEND, REPLACE, TableStore, change_tables
from batchtrace.sources.tpch import BAG_SCOPE, domain
from batchtrace.streaming import register_stream as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def render_formulations(f: DataFrame) -> DataFrame:
    return f.select(
        "set_code", "weight_code", "batch_variant_code", "base_code", "created_at", "created_by", "sku_count",
        V.skus_text("sku_list").alias("sku_list_text"),
        V.pairs_text("batch_items", "sku", "ingredient_batch_code").alias("batch_items_text"),
        V.pairs_text("dry_weight_items", "sku", "wt_percent").alias("dry_weight_items_text"))


@query
def sets_view(spark, sf_dir):
    s = V.sets(domain(spark, sf_dir))
    return s.select("set_code", "set_hash", "created_at", "created_by", "notes", "material_workstream",
                    V.skus_text("sku_list").alias("sku_list_text"), F.size("sku_list").alias("sku_count"))


@query
def weight_variants(spark, sf_dir):
    w = V.weights(domain(spark, sf_dir))
    return w.select("set_code", "weight_code", "weight_hash", "created_at", "created_by",
                    V.pairs_text("items", "sku", "wt_percent").alias("items_text"))


@query
def batch_variants(spark, sf_dir):
    b = V.variants(domain(spark, sf_dir))
    return b.select("set_code", "weight_code", "batch_variant_code", "batch_hash", "created_at", "created_by",
                    V.pairs_text("items", "sku", "ingredient_batch_code").alias("items_text"))


@query
def formulations_flat(spark, sf_dir):
    return render_formulations(V.formulations(domain(spark, sf_dir)))


# ---- search, paging, lineage (L4-L18) ----------------------------------------------------

# Fixed query parameters of the registered examples.
SKU_TEXT = "_001"
PAGE_NO, PAGE_SIZE = 3, 50


@query
def formulations_search(spark, sf_dir):
    """L4 + P4/K4: formulations whose SKU-list JSON text contains a search string."""
    return render_formulations(LN.formulations_search(domain(spark, sf_dir), sku=SKU_TEXT))


@query
def formulations_page(spark, sf_dir):
    """L4 + O2: page 3 (50 rows) newest first."""
    rows, _ = LN.formulations_page(domain(spark, sf_dir), page_no=PAGE_NO, size=PAGE_SIZE)
    return render_formulations(rows)


@query
def formulations_total(spark, sf_dir):
    """A5 + O6: total formulations with SKU filter, with page flags."""
    _, tot = LN.formulations_page(domain(spark, sf_dir), sku=SKU_TEXT, page_no=PAGE_NO, size=PAGE_SIZE)
    return O.page_flags(tot, PAGE_NO, PAGE_SIZE)


@query
def formulations_by_batch(spark, sf_dir):
    """Where-used of every stored batch."""
    return LN.formulations_by_batch(domain(spark, sf_dir)).select(
        "sku", "ingredient_batch_code", "set_code", "weight_code", "batch_variant_code", "base_code", "created_at")


@query
def sku_summary_formulations(spark, sf_dir):
    return LN.sku_summary_formulations(domain(spark, sf_dir))


@query
def sku_summary_ingredient(spark, sf_dir):
    """Ingredient rows of every SKU in a recipe."""
    t = domain(spark, sf_dir)
    return LN.sku_summary_ingredient(t, t.batch_variant_items).select("sku", "trade_name_inci", "supplier", "format", "created_at")


@query
def compounding_how_page(spark, sf_dir):
    """Compounding hows whose code or suffix has 'ab', newest first, first page."""
    rows, _ = O.page(LN.compounding_how_rows(domain(spark, sf_dir), "ab"), "compounding_how", 1, PAGE_SIZE)
    return rows.select("processing_code", "process_code_suffix", "failure_mode", "location_code", "created_at")


@query
def conversion_how_codes(spark, sf_dir):
    return LN.lookup_list(domain(spark, sf_dir), spark, "conversion_how_codes")


@query
def compounding_how_codes(spark, sf_dir):
    return LN.lookup_list(domain(spark, sf_dir), spark, "compounding_how_codes")


@query
def location_ids(spark, sf_dir):
    return LN.lookup_list(domain(spark, sf_dir), spark, "location_ids")


@query
def sku_summary_bags(spark, sf_dir):
    return LN.sku_summary_bags(domain(spark, sf_dir))


@query
def bag_detail(spark, sf_dir):
    return LN.bag_detail(domain(spark, sf_dir)).select(
        "pellet_bag_id", "pellet_bag_code", "compounding_how_code", "location_code", "failure_mode",
        "location_partner_code", "compounding_partner_name", "machine", "formulation_base_code")


@query
def how_detail(spark, sf_dir):
    return LN.how_detail(domain(spark, sf_dir)).select(
        "processing_code", "location_code", "failure_mode", "pellet_bag_code", "product_type", "bag_mass_kg")


@query
def batch_selection_detail(spark, sf_dir):
    return LN.batch_selection_detail(domain(spark, sf_dir)).select(
        "base_code", "location_id", "partner_code", "production_date", "processing_code", "pellet_bag_code")


LOCATION_Q = "aa"


@query
def location_page(spark, sf_dir):
    """Location codes containing 'aa', page 1 with partner labels."""
    rows, _ = O.page(LN.location_rows(domain(spark, sf_dir), spark, LOCATION_Q), "location_codes", 1, PAGE_SIZE)
    return rows.select("location_id", "partner_code", "partner_name", "machine_specification", "created_at")


@query
def location_labels(spark, sf_dir):
    """J15 + J16 over every location code (no paging)."""
    return LN.location_rows(domain(spark, sf_dir), spark).select(
        "location_id", "partner_code", "partner_name", "machine_specification")


@query
def context_page(spark, sf_dir):
    """Contexts containing ' pf ', page 2 with partner labels."""
    rows, _ = O.page(LN.context_rows(domain(spark, sf_dir), " pf "), "contexts", 2, PAGE_SIZE)
    return rows.select(F.col("context_code").alias("conversion_code"), F.col("created_by").alias("owner"),
                       "created_at", "conversion_partner")


@query
def conversion_how_page(spark, sf_dir):
    rows, _ = O.page(LN.conversion_how_rows(domain(spark, sf_dir), "ab"), "conversion_hows", 1, PAGE_SIZE)
    return rows.select("conversion1_how_code", "context_code", "process_code", "failure_mode", "created_at")


@query
def products_page(spark, sf_dir):
    """Active products whose code contains '0001', page 1 of 200."""
    rows, _ = O.page(LN.product_rows(domain(spark, sf_dir), q="0001"), "products", 1, 200)
    return rows.select("product_code", "conversion1_how_code", "product_suffix", "storage_location",
                       "tensile_rigid_status", "tensile_films_status", "created_at")


@query
def bags_search(spark, sf_dir):
    """Active bags whose code LIKE '%pf 000%' (case-insensitive)."""
    return LN.bag_rows(domain(spark, sf_dir), "pf 000").select(
        "pellet_bag_id", "pellet_bag_code", "compounding_how_code", "product_type", "sequence_number",
        "bag_mass_kg", "remaining_mass_kg", "qc_status", "created_at")


@query
def ingredients_search(spark, sf_dir):
    """LIKE 'ring' over sku/trade name/supplier, format = Powder, sorted (O1)."""
    return O.sort_listing(LN.ingredient_rows(domain(spark, sf_dir), "ring", {"format": "Powder"}), "ingredients") \
        .select("sku", "category_code", "seq", "pack_size_value", "trade_name_inci", "supplier", "spec_grade")


@query
def batches_page(spark, sf_dir):
    """Live (not archived) batches, page 2 of 100."""
    rows, _ = O.page(LN.batch_rows(domain(spark, sf_dir)), "batches", 2, 100)
    return rows.select("sku", "ingredient_batch_code", "archived", "quantity_value", "created_at")


def _status_query(col):
    def fn(spark, sf_dir):
        return LN.status_queue(domain(spark, sf_dir), col)
    fn.__name__ = f"status_queue_{col.replace('_status', '')}"
    fn.__doc__ = f"L13: newest 25 open items of {col}."
    return fn


for _c in ["qc_status", "long_moisture_status", "density_status", "injection_moulding_status",
           "film_forming_status"]:
    query(_status_query(_c))


@query
def dashboard_kpis(spark, sf_dir):
    return LN.dashboard_kpis(domain(spark, sf_dir))


@query
def dependency_counts(spark, sf_dir):
    t = domain(spark, sf_dir)
    return A.dependency_counts(t.dry_weight_variants, t.batch_variants, t.location_codes)


@query
def distinct_formulations(spark, sf_dir):
    return LN.lookup_list(domain(spark, sf_dir), spark, "formulation_codes")


@query
def partner_registry(spark, sf_dir):
    """J15 + S2: custom partners overlaid on the defaults."""
    return LN.lookup_list(domain(spark, sf_dir), spark, "partners")


@query
def partner_machine_options(spark, sf_dir):
    return LN.lookup_list(domain(spark, sf_dir), spark, "partner_machine_options")


@query
def bag_code_list(spark, sf_dir):
    return LN.lookup_list(domain(spark, sf_dir), spark, "bag_codes")


@query
def recipe_lines(spark, sf_dir):
    return LN.recipe_lines(domain(spark, sf_dir))


def _matrix_text(df, keys):
    return df.select(*keys, "n_columns", F.array_join(F.transform(
        "cells", lambda c: F.concat(c["col"].cast("string"), F.lit("="), F.coalesce(c["value"], F.lit("")))), "|")
        .alias("cells_text"))


@query
def weight_matrix(spark, sf_dir):
    """Sparse weight matrix rows of every set."""
    return _matrix_text(LN.weight_matrix(domain(spark, sf_dir)), ["set_code", "weight_code"])


@query
def weight_matrix_columns(spark, sf_dir):
    return LN.matrix_columns(domain(spark, sf_dir), "weight").select(
        "set_code", F.array_join("columns", ",").alias("columns_text"))


@query
def batch_matrix(spark, sf_dir):
    return _matrix_text(LN.batch_matrix(domain(spark, sf_dir)), LN.FORM_KEYS)


@query
def batch_matrix_columns(spark, sf_dir):
    return LN.matrix_columns(domain(spark, sf_dir), "batch").select(
        "set_code", "weight_code", F.array_join("columns", ",").alias("columns_text"))


@query
def batch_candidates(spark, sf_dir):
    return LN.batch_candidates(domain(spark, sf_dir))


@query
def next_code_per_context(spark, sf_dir):
    """A10: next process code per conversion context."""
    return A.next_code_per_context(domain(spark, sf_dir).conversion1_how)


@query
def next_compounding_suffix(spark, sf_dir):
    """A11."""
    return A.next_suffix(domain(spark, sf_dir).compounding_how)


@query
def query_cost_rollup(spark, sf_dir):
    r = A.query_cost_rollup(domain(spark, sf_dir).query_log)
    return r.select("request_id", F.round("query_ms", 2).alias("query_ms"), "query_count")


@query
def parse_sku(spark, sf_dir):
    """F3/F4 round trip: parse every SKU in its current and legacy (no '_') form."""
    ing = domain(spark, sf_dir).ingredients.select("sku")
    forms = ing.select("sku", F.lit("current").alias("form"), F.col("sku").alias("text")).unionByName(
        ing.select("sku", F.lit("legacy").alias("form"), F.regexp_replace("sku", "_", "").alias("text")))
    p = forms.select("sku", "form", "text", C.parse_sku("text").alias("p"))
    return p.select("sku", "form", "text", "p.category_code", "p.seq", "p.pack_size_value", "p.error",
                    C.format_sku("p.category_code", "p.seq", "p.pack_size_value").alias("formatted"))


@query
def weight_hash(spark, sf_dir):
    """F16: recompute every weight-variant hash from its items and compare."""
    w = V.weights(domain(spark, sf_dir))
    h = H.hash_weights("items")
    return w.select("set_code", "weight_code", "weight_hash", h.alias("computed_hash"),
                    (h == F.col("weight_hash")).alias("matches"))


@query
def set_hash_check(spark, sf_dir):
    """F16: recompute every set hash from its SKU list."""
    s = V.sets(domain(spark, sf_dir))
    return s.select("set_code", "set_hash", H.hash_set("sku_list").alias("computed_hash"))


@query
def misplaced_sku_repair(spark, sf_dir):
    """F25 over every set, in its stored form and in a misplaced form (SKUs written into
    the workstream text, list empty)."""
    s = V.sets(domain(spark, sf_dir)).select("set_code", "sku_list", "material_workstream")
    bad = s.select("set_code", F.array().cast("array<string>").alias("sku_list"),
                   F.array_join("sku_list", ", ").alias("material_workstream"))
    both = s.withColumn("variant", F.lit("stored")).unionByName(bad.withColumn("variant", F.lit("misplaced")))
    skus, ws = TX.misplaced_sku_repair("sku_list", "material_workstream")
    return both.select("set_code", "variant", F.array_join(skus, ",").alias("sku_list_text"),
                       ws.alias("material_workstream"))


# ---- registration (M1-M14) -----------------------------------------------------------------

AS_OF = "2025-01-01 00:00:00"


def _outcomes(accepted: DataFrame, rejects: DataFrame, code_cols: list[str]) -> DataFrame:
    """Accepted and rejected requests in one frame: request_id, outcome, codes, rule, message."""
    a = accepted.select(F.col("request_id").cast("string").alias("request_id"), "outcome",
                        *[F.col(c).cast("string").alias(c) for c in code_cols],
                        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("message"))
    r = rejects.select(F.col("request_id").cast("string").alias("request_id"), F.lit("rejected").alias("outcome"),
                       *[F.lit(None).cast("string").alias(c) for c in code_cols], "rule", "message")
    return a.unionByName(r)


@query
def scoped_codes(spark, sf_dir):
    """M1: one code per location request, numbered per formulation scope in request order
    from the scope's counter (missing counter starts at 1)."""
    t = domain(spark, sf_dir)
    rows, _ = M.assign_scoped(t.req_locations, ["set_code", "weight_code"], t.code_counters,
                              "batch_variant_code", 1)
    return rows.select(F.col("request_id"), "set_code", "weight_code", "value",
                       C.int_to_code("value").alias("code"))


@query
def global_bag_numbers(spark, sf_dir):
    """M2: contiguous global sequence ranges for bag requests (one row per number)."""
    t = domain(spark, sf_dir)
    rows, _ = M.assign_ranges(t.req_bags, BAG_SCOPE, "number_of_bags", t.code_counters, "pellet_bag_sequence", 0)
    return rows.select("request_id", "offset", "value")


@query
def register_sets(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_sets(t.req_sets, t, AS_OF)
    return _outcomes(acc, rej, ["set_code", "set_hash"])


@query
def register_weights(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_weights(t.req_weights, t, AS_OF)
    return _outcomes(acc, rej, ["set_code", "weight_code", "weight_hash"])


@query
def register_variants(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_batch_variants(t.req_variants, t, AS_OF)
    return _outcomes(acc, rej, ["set_code", "weight_code", "batch_variant_code", "batch_hash"])


@query
def register_ingredients(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_ingredients(t.req_ingredients, t, AS_OF)
    return _outcomes(acc, rej, ["sku", "seq"])


@query
def register_import(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.import_ingredients(t.req_imports, t, AS_OF)
    return _outcomes(acc, rej, ["sku", "seq"])


@query
def register_locations(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_locations(t.req_locations, t, spark, AS_OF)
    return _outcomes(acc, rej, ["location_id"])


@query
def register_partners(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_partners(t.req_partners, t, spark, AS_OF)
    return _outcomes(acc, rej, ["partner_code"])


@query
def register_hows(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_hows(t.req_hows, t, AS_OF)
    return _outcomes(acc, rej, ["processing_code"])


@query
def register_bags(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.mint_bags(t.req_bags, t, AS_OF)
    return _outcomes(acc, rej, ["pellet_bag_code", "sequence_number"])


@query
def register_contexts(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.get_or_create_contexts(t.req_contexts, t, AS_OF)
    return _outcomes(acc, rej, ["context_code"])


@query
def register_conversion_hows(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.register_conversion_hows(t.req_conversion_hows, t, AS_OF)
    return _outcomes(acc, rej, ["conversion1_how_code"])


@query
def register_products(spark, sf_dir):
    t = domain(spark, sf_dir)
    acc, rej, _ = M.mint_products(t.req_products, t, AS_OF)
    return _outcomes(acc, rej, ["product_code"])


# ---- single functions over whole tables ---------------------------------------------------------

@query
def used_ingredients(spark, sf_dir):
    """Ingredients whose SKU is in the list of SKUs that recipes use."""
    t = domain(spark, sf_dir)
    return P.where_in(t.ingredients, "sku", t.batch_variant_items.select("sku")).select("sku", "category_code", "seq")


@query
def batch_lookup(spark, sf_dir):
    """The stored batch of each requested (sku, batch) key."""
    t = domain(spark, sf_dir)
    keys = t.req_variants.select(F.explode("items").alias("i")).select("i.sku", "i.ingredient_batch_code")
    return P.lookup(t.ingredient_batches, keys, ["sku", "ingredient_batch_code"]).select(
        "sku", "ingredient_batch_code", "quantity_value", "archived")


@query
def clamped_page(spark, sf_dir):
    """Page 0 of size 1000 is clamped to page 1 of size 200."""
    rows, _ = O.page(domain(spark, sf_dir).location_codes, "location_codes", 0, 1000)
    return rows.select("location_id", "partner_code", "created_at")


@query
def combined_permissions(spark, sf_dir):
    """U4: each user's role permissions together with the mixing role's."""
    t = domain(spark, sf_dir)
    held = X.effective_access(spark, _users(t), t.user_roles)
    both = X.union_permissions("permissions", F.array(*[F.lit(p) for p in R.MIXING_1_PERMISSIONS]))
    return held.select("email", F.array_join(both, ",").alias("permissions_text"))


@query
def json_rows(spark, sf_dir):
    """ingredients as JSON-safe rows."""
    t = domain(spark, sf_dir)
    return t.ingredients.select("sku", TX.json_row("sku", "seq", "created_at", "is_active").alias("row_json"))


@query
def parsed_timestamps(spark, sf_dir):
    """order times written as ISO text, naive, in UTC or with an offset."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 3
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(k == 0, "").when(k == 1, "Z").otherwise("+02:00"))
    return o.select("o_orderkey", TX.parse_iso_ts(text).alias("at"))


@query
def exact_weights(spark, sf_dir):
    """UD1: exact half-up rounding of eighths, Arrow-batched."""
    ship(spark)
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", round_weight_exact(F.col("l_quantity") / 8).alias("rounded"))


@query
def folded_names(spark, sf_dir):
    """UD2: case-folded search text of trade names, Arrow-batched."""
    ship(spark)
    return domain(spark, sf_dir).ingredients.select("sku", nfkc_casefold("trade_name_inci").alias("folded"))


# ---- rows that registration writes (M3, M11, M12, M14) -----------------------------------------

@query
def written_sets(spark, sf_dir):
    """M3: headers, items, metadata updates and the counter that the set registration writes."""
    t = domain(spark, sf_dir)
    _, _, new = M.register_sets(t.req_sets, t, AS_OF)
    none = F.lit(None).cast("string")
    counter = new["code_counters"].where("counter_name = 'set_code'")
    return (new["ingredient_sets"].select(F.lit("header").alias("part"), "set_code", F.col("set_hash").alias("value"), "notes",
                                          F.col("created_by").alias("actor"))
            .unionByName(new["ingredient_set_items"].select(F.lit("item").alias("part"), "set_code", F.col("sku").alias("value"),
                                                            none.alias("notes"), F.col("created_by").alias("actor")))
            .unionByName(new["set_meta_updates"].select(F.lit("meta").alias("part"), "set_code", none.alias("value"), "notes", "actor"))
            .unionByName(counter.select(F.lit("counter").alias("part"), F.col("scope").alias("set_code"),
                                        F.col("next_value").cast("string").alias("value"), none.alias("notes"),
                                        none.alias("actor"))))


@query
def written_bags(spark, sf_dir):
    """The bag rows written, optional fields included."""
    t = domain(spark, sf_dir)
    _, _, new = M.mint_bags(t.req_bags, t, AS_OF)
    return new["pellet_bags"].select(
        "pellet_bag_code", "pellet_bag_id", "compounding_how_code", "product_type", "sequence_number", "bag_mass_kg",
        "remaining_mass_kg", "short_moisture_percent", "purpose", "reference_sample_taken", "qc_status", "density_status",
        "long_moisture_status", "density_assignee_email", "notes", "customer", "created_by")


@query
def written_contexts(spark, sf_dir):
    """The context rows written."""
    t = domain(spark, sf_dir)
    _, _, new = M.get_or_create_contexts(t.req_contexts, t, AS_OF)
    return new["conversion1_context"].select("context_code", "pellet_bag_code", "partner_code", "machine_code", "date_yymmdd",
                                             "created_by", "is_active")


@query
def written_products(spark, sf_dir):
    """The product rows written, optional fields and defaults included."""
    t = domain(spark, sf_dir)
    _, _, new = M.mint_products(t.req_products, t, AS_OF)
    return new["conversion1_products"].select(
        "product_code", "conversion1_how_code", "product_suffix", "storage_location", "notes", "numbered_in_order",
        "tensile_rigid_status", "tensile_films_status", "solubility_status", "friction_status", "width_mm",
        "sd_film_thickness", "created_by")


# ---- table changes (R1-R12) ------------------------------------------------------------------


@query
def upsert_roles(spark, sf_dir):
    """Role upsert by normalised email; the new user_roles snapshot."""
    t = domain(spark, sf_dir)
    new, _ = CH.upsert_roles(t.user_roles, t.chg_roles, AS_OF, ["ts", "event_id"])
    return new.select("email", "first_name", "last_name", "role_group", F.array_join("permissions", ",").alias("permissions"),
                      "is_active", "created_at", "created_by", "updated_at", "updated_by")


@query
def role_rejects(spark, sf_dir):
    """Role changes without an email or with an unknown role."""
    return CH.role_rejects(domain(spark, sf_dir).chg_roles).select("event_id", "email", "role_group", "reason")


@query
def upsert_roles_counts(spark, sf_dir):
    t = domain(spark, sf_dir)
    _, counts = CH.upsert_roles(t.user_roles, t.chg_roles, AS_OF, ["ts", "event_id"])
    return counts


@query
def counter_floor(spark, sf_dir):
    """Raise counters to floors (insert missing ones)."""
    t = domain(spark, sf_dir)
    new, _ = CH.raise_floor(t.code_counters, t.chg_floors, AS_OF)
    return new


@query
def seed_counters(spark, sf_dir):
    """R2: seed-if-absent MERGE of the default counters."""
    t = domain(spark, sf_dir)
    seeds = spark.createDataFrame([("set_code", "", 1), ("location_partner_code", "", R.PARTNER_CODE_START),
                                   ("ingredient_seq", "global", 1), ("pellet_bag_sequence", "pellet_bag:global", 0)],
                                  "counter_name string, scope string, next_value long") \
        .withColumn("updated_at", F.lit(AS_OF).cast("timestamp_ntz"))
    new, _ = CH.seed_absent(t.code_counters, seeds, ["counter_name", "scope"])
    return new


@query
def patch_bags(spark, sf_dir):
    """Keep-null patch of bags by bag id (NULL means keep; a bag may have several changes)."""
    t = domain(spark, sf_dir)
    new, _, _ = CH.patch_bags(t.pellet_bags, t.chg_bags.drop("pellet_bag_code"), AS_OF, ["pellet_bag_id"])
    return new.select("pellet_bag_id", "pellet_bag_code", *CH.BAG_PATCH_COLUMNS, "updated_at", "updated_by")


@query
def patch_bag_rejects(spark, sf_dir):
    """Bag changes to a negative remaining mass."""
    t = domain(spark, sf_dir)
    return CH.patch_bags(t.pellet_bags, t.chg_bags.drop("pellet_bag_code"), AS_OF, ["pellet_bag_id"])[1]


@query
def patch_products(spark, sf_dir):
    """Listed-column patch of products (NULL overwrites supplied columns only)."""
    t = domain(spark, sf_dir)
    new, _ = CH.patch_columns(t.conversion1_products, t.chg_products, ["product_code"], CH.PRODUCT_PATCH_COLUMNS, AS_OF)
    return new.select("product_code", *CH.PRODUCT_PATCH_COLUMNS, "updated_at", "updated_by")


@query
def archive_batches(spark, sf_dir):
    """Archive toggle on batches."""
    t = domain(spark, sf_dir)
    new, _ = CH.set_archived(t.ingredient_batches, t.chg_archive, AS_OF)
    return new.select("sku", "ingredient_batch_code", "archived", "archived_at", "archived_by", "updated_at",
                      "updated_by")


@query
def status_update(spark, sf_dir):
    """Status + assignee updates; the new status columns of every bag."""
    t = domain(spark, sf_dir)
    new, _, _ = CH.update_status(t.pellet_bags, t.chg_status, t.pellet_bag_assignees, AS_OF, ["submitted_at"])
    return new.select("pellet_bag_code", *R.EDITABLE_STATUS_COLUMNS,
                      *[R.STATUS_ASSIGNEE[c] for c in R.EDITABLE_STATUS_COLUMNS], "updated_at", "updated_by")


@query
def status_update_rejects(spark, sf_dir):
    t = domain(spark, sf_dir)
    _, rej, _ = CH.update_status(t.pellet_bags, t.chg_status, t.pellet_bag_assignees, AS_OF, ["submitted_at"])
    return rej.select("pellet_bag_code", "status_column", "status_value", "assigned_value", "reason")


@query
def update_hows(spark, sf_dir):
    """R8."""
    t = domain(spark, sf_dir)
    new, _ = CH.update_hows(t.compounding_how, t.chg_hows, AS_OF)
    return new.select("processing_code", "failure_mode", "machine_setup_url", "processed_data_url", "notes",
                      "updated_at", "updated_by")


@query
def set_meta(spark, sf_dir):
    """R9."""
    t = domain(spark, sf_dir)
    new, _ = CH.update_set_meta(t.ingredient_sets, t.chg_set_meta)
    return new.select("set_code", "notes", "material_workstream", "created_by")


@query
def set_document(spark, sf_dir):
    """Newest safety-sheet pointer per ingredient (accepted uploads only, Q8)."""
    t = domain(spark, sf_dir)
    bad = Q.check_documents(t.doc_manifest, t.ingredients, ["sku"], "msds_object_path")
    ok = t.doc_manifest.join(bad.select("sku", "filename"), ["sku", "filename"], "left_anti")
    new, _ = CH.set_document(t.ingredients, ok, ["sku"], "msds", AS_OF)
    return new.select("sku", "msds_object_path", "msds_filename", "msds_content_type", "msds_uploaded_at",
                      "updated_at", "updated_by")


@query
def set_spec_document(spark, sf_dir):
    """Newest spec sheet of every received batch (two uploads each); the actor is not stamped."""
    t = domain(spark, sf_dir)
    b = t.ingredient_batches.where("received_at IS NOT NULL").select("sku", "ingredient_batch_code", "received_at")
    last = b.select("sku", "ingredient_batch_code", F.concat(F.lit("specs/"), "sku", F.lit("/"), "ingredient_batch_code", F.lit(".pdf"))
                    .alias("object_path"), F.timestamp_add("DAY", F.lit(3), F.col("received_at")).alias("uploaded_at"))
    first = b.select("sku", "ingredient_batch_code", F.concat(F.lit("specs/"), "sku", F.lit("/first.pdf")).alias("object_path"),
                     F.col("received_at").alias("uploaded_at"))
    uploads = last.unionByName(first).withColumn("actor", F.lit("admin@example.com"))
    new, _ = CH.set_document(t.ingredient_batches, uploads, ["sku", "ingredient_batch_code"], "spec", AS_OF)
    return new.select("sku", "ingredient_batch_code", "spec_object_path", "spec_uploaded_at", "updated_at", "updated_by")


@query
def cascade_delete(spark, sf_dir):
    """A delete request for the set of every order and for every newly registered set; sets with
    dependants are blocked with their counts."""
    t = domain(spark, sf_dir)
    _, _, made = M.register_sets(t.req_sets, t, AS_OF)
    codes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("set_code")).unionByName(made["ingredient_sets"].select("set_code"))
    deps = A.dependency_counts(t.dry_weight_variants, t.batch_variants, t.location_codes)
    sets, _, blocked = CH.delete_sets(t.ingredient_sets.unionByName(made["ingredient_sets"]),
                                      t.ingredient_set_items.unionByName(made["ingredient_set_items"]), codes, deps)
    kept = sets.select("set_code", F.lit("kept").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(blocked.select("set_code", F.lit("blocked").alias("outcome"), "reason"))


@query
def seed_assignees(spark, sf_dir):
    """Default assignees (here: everyone who created a bag) only if no active assignee
    exists."""
    t = domain(spark, sf_dir)
    defaults = t.pellet_bags.where("created_by IS NOT NULL").select(F.col("created_by").alias("email")).distinct() \
        .select("email", F.lit(True).alias("is_active"), F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"),
                F.lit(None).cast("string").alias("created_by"))
    return CH.seed_if_empty(t.pellet_bag_assignees, defaults)


# ---- quality (Q1-Q9) -------------------------------------------------------------------------

@query
def quality_ingredients(spark, sf_dir):
    return Q.check_ingredients(domain(spark, sf_dir).ingredients, "sku")


@query
def quality_weights(spark, sf_dir):
    return Q.check_weight_sum(domain(spark, sf_dir).dry_weight_items, ["set_code", "weight_code"])


@query
def quality_weight_close(spark, sf_dir):
    """Q3/A12 on every formulation: float total of aligned weights and the tolerance check."""
    f = V.formulations(domain(spark, sf_dir))
    return f.select(*["set_code", "weight_code", "batch_variant_code"],
                    F.round(Q.weight_total("dry_weight_items"), 6).alias("total"),
                    Q.weight_sum_close("dry_weight_items", 0.01).alias("close"))


@query
def quality_enums(spark, sf_dir):
    vocab = dict(R.STATUS_VOCAB)
    vocab["purpose"] = R.PURPOSE_OPTIONS
    vocab["reference_sample_taken"] = R.REFERENCE_SAMPLE_OPTIONS
    return Q.check_enums(domain(spark, sf_dir).pellet_bags, ["pellet_bag_id"], vocab)


@query
def quality_membership(spark, sf_dir):
    """Q5: batch variants whose SKUs are not all active SKUs of their set."""
    t = domain(spark, sf_dir)
    bv = V.variants(t).select(F.concat_ws(" ", "set_code", "weight_code", "batch_variant_code").alias("base_code"),
                              "set_code", F.transform("items", lambda x: x["sku"]).alias("skus"))
    usable = t.ingredient_set_items.join(t.ingredients.where("is_active").select("sku"), "sku", "left_semi")
    return Q.check_membership(bv, "skus", usable.select("set_code", "sku"), "sku",
                              "SKUs outside set: ", scope=["set_code"], key="base_code")


@query
def quality_bounds(spark, sf_dir):
    return Q.check_bounds(domain(spark, sf_dir).pellet_bags, ["pellet_bag_id"],
                          {"bag_mass_kg": (0, None), "remaining_mass_kg": (0, None), "short_moisture_percent": (0, 100)})


@query
def quality_patch(spark, sf_dir):
    return Q.check_nonempty_patch(domain(spark, sf_dir).chg_bags, ["pellet_bag_code"],
                                  ["remaining_mass_kg", "notes", "customer"])


@query
def quality_documents(spark, sf_dir):
    t = domain(spark, sf_dir)
    return Q.check_documents(t.doc_manifest, t.ingredients, ["sku"], "msds_object_path")


@query
def quality_assignees(spark, sf_dir):
    t = domain(spark, sf_dir)
    return Q.check_assignees(t.pellet_bags, ["pellet_bag_id"], [R.STATUS_ASSIGNEE[c] for c in R.EDITABLE_STATUS_COLUMNS],
                             t.pellet_bag_assignees)


# ---- access policy (X1-X4) -------------------------------------------------------------------

def _users(t):
    """Everyone who acted on bags, plus every stored role holder (some with an
    identity-provider prefix)."""
    a = t.pellet_bags.select(F.col("created_by").alias("email")).where("email IS NOT NULL")
    b = t.user_roles.select(F.when(F.length("email") % 2 == 0, F.concat(F.lit("idp.example.com:"), F.upper("email")))
                            .otherwise(F.col("email")).alias("email"))
    return a.unionByName(b)


@query
def role_permissions(spark, sf_dir):
    return X.user_permissions(spark, domain(spark, sf_dir).user_roles)


@query
def effective_access(spark, sf_dir):
    t = domain(spark, sf_dir)
    a = X.effective_access(spark, _users(t), t.user_roles)
    return a.select("email", "role_group", "is_admin", "is_bootstrap_admin", F.size("permissions").alias("n_permissions"),
                    "can_view_dry_weights")


@query
def masked_formulations(spark, sf_dir):
    """X3 per row: each formulation's dry weights shown only when its owner may view them."""
    t = domain(spark, sf_dir)
    return render_formulations(masked(t, X.effective_access(spark, _users(t), t.user_roles)))


def masked(t, access: DataFrame) -> DataFrame:
    """L4 with each formulation's weights masked by its owner's ``access``, one row per access row of the owner.
    Access is joined to the narrow headers (as two counts per owner), not to the recipes."""
    yes = F.coalesce("can_view_dry_weights", F.lit(False))
    acc = access.groupBy(F.col("email").alias("created_by")).agg(F.count_if(yes).alias("_may"), F.count_if(~yes).alias("_may_not"))
    heads = t["batch_variants"].join(acc, "created_by", "left").fillna({"_may": 0, "_may_not": 1})
    tables = {n: t[n] for n in ("batch_variant_items", "dry_weight_variants", "dry_weight_items")} | {"batch_variants": heads}
    flags = F.concat(F.array_repeat(F.lit(True), F.col("_may").cast("int")), F.array_repeat(F.lit(False), F.col("_may_not").cast("int")))
    f = V.formulations(tables, ("_may", "_may_not")).withColumn("can_view_dry_weights", F.explode(flags))
    return X.mask_weights(f.drop("_may", "_may_not"), flag_col="can_view_dry_weights")


@query
def sku_summary_masked(spark, sf_dir):
    """The formulations section of the SKU summary for each formulation's owner; empty for
    owners who may not view batch selections."""
    t = domain(spark, sf_dir)
    owners = t.batch_variants.select(*LN.FORM_KEYS, F.col("created_by").alias("viewer")).distinct()
    section = LN.sku_summary_formulations(t).join(owners, LN.FORM_KEYS)
    return X.mask_section(section, X.effective_access(spark, _users(t), t.user_roles), "batch_selection.view")


# ---- streaming (T1) ----------------------------------------------------------------------------


def _stream_in_arrivals(spark, t, kind: str, req: DataFrame, label: str, arrivals: int = 3) -> DataFrame:
    """Feed ``req`` to the registration stream in ``arrivals`` groups of request files (in
    request order), one availableNow run of the same query per arrival; return outcomes."""
    work = f"{checkpoint_dir(spark).rstrip('/')}/stream-{label}-{uuid.uuid4().hex}"
    ordered = sequence_within(req, [], M.ORDER, out="_pos")
    n = ordered.count()
    ordered = ordered.withColumn("_arrival", F.floor(F.col("_pos") * arrivals / F.lit(max(n, 1))))
    for i in range(arrivals):
        ordered.where(F.col("_arrival") == i).drop("_pos", "_arrival").write.mode("append").parquet(f"{work}/in")
        q = T.stream_register(spark, f"{work}/in", kind, t, f"{work}/state", f"{work}/checkpoint",
                              req.schema, AS_OF, files_per_trigger=None)
        q.awaitTermination()
    return T.read_outcomes(spark, f"{work}/state")


@query
def stream_register_sets(spark, sf_dir):
    """Set registration as a stream. The request batch arrives as three file groups in
    request order; each arrival is processed by one availableNow run of the same streaming
    query (restarting from its checkpoint), appending new sets to the state. The final
    codes equal those of the one-shot job."""
    t = domain(spark, sf_dir)
    out = _stream_in_arrivals(spark, t, "sets", t.req_sets, "sets")
    return out.select("request_id", (F.col("outcome") != "rejected").alias("accepted"), "set_code", "rule")


CHAIN_DAY, CHAIN_CODE = "240115", "AB"


@query
def stream_chain(spark, sf_dir):
    """Nine kinds of requests through one state, each kind made from the codes that the kinds before
    it got: sets, weights, variants, locations, hows, bags, contexts, conversion hows, products."""
    t = domain(spark, sf_dir)
    work = f"{checkpoint_dir(spark).rstrip('/')}/stream-chain-{uuid.uuid4().hex}"
    at = F.lit(AS_OF).cast("timestamp_ntz").alias("submitted_at")
    actor = F.lit("chain@example.com").alias("actor")

    def feed(kind: str, requests: DataFrame) -> T.StreamState:
        requests.write.parquet(f"{work}/{kind}/in")
        T.stream_register(spark, f"{work}/{kind}/in", kind, t, f"{work}/state", f"{work}/{kind}/checkpoint", requests.schema,
                          AS_OF, files_per_trigger=None).awaitTermination()
        return T.StreamState(spark, t, f"{work}/state")

    def done(kind: str) -> DataFrame:
        return T.read_outcomes(spark, f"{work}/state", kind).where("outcome = 'created'")

    state = feed("sets", t.req_sets)
    skus = state["ingredient_set_items"].join(done("sets").select("set_code"), "set_code", "left_semi").groupBy("set_code").agg(
        F.sort_array(F.collect_set("sku")).alias("skus"))
    one = F.floor(F.lit(10000) / F.size("skus")) / 100
    items = F.transform("skus", lambda s, i: F.struct(s.alias("sku"), F.when(i == 0, 100 - one * (F.size("skus") - 1)).otherwise(one)
                                                      .alias("wt_percent")))
    state = feed("weights", skus.select(F.col("set_code").alias("request_id"), at, "set_code", items.alias("items"),
                                        F.lit(None).cast("string").alias("notes"), actor))
    batch = t.ingredient_batches.groupBy("sku").agg(F.min("ingredient_batch_code").alias("ingredient_batch_code"))
    lines = state["dry_weight_items"].join(done("weights").select("set_code", "weight_code"), ["set_code", "weight_code"], "left_semi")
    lines = lines.join(batch, "sku").groupBy("set_code", "weight_code").agg(
        F.sort_array(F.collect_list(F.struct("sku", "ingredient_batch_code"))).alias("items"))
    feed("variants", lines.select(F.col("set_code").alias("request_id"), at, "set_code", "weight_code", "items", actor))
    option = t.location_partners.where("trim(partner_code) <> '' AND trim(machine_specification) <> ''").agg(
        F.min(F.struct(F.trim("partner_code").alias("partner_code"), F.trim("machine_specification").alias("machine_code"))).alias("o"))
    option = option.select("o.*")
    variants = done("variants").select("set_code", "weight_code", "batch_variant_code")
    feed("locations", variants.crossJoin(F.broadcast(option)).select(  # one row
        F.col("set_code").alias("request_id"), at, "set_code", "weight_code", "batch_variant_code", "partner_code",
        F.lit(CHAIN_DAY).alias("production_date"), actor))
    text = lambda name: F.lit(None).cast("string").alias(name)
    feed("hows", done("locations").select("request_id", at, F.col("location_id").alias("location_code"),
                                          F.lit(CHAIN_CODE).alias("process_code_suffix"), F.lit(R.FAILURE_MODES[0]).alias("failure_mode"),
                                          text("machine_setup_url"), text("processed_data_url"), text("notes"), actor))
    feed("bags", done("hows").select("request_id", at, F.col("processing_code").alias("compounding_how_code"),
                                     F.lit("PF").alias("product_type"), F.lit(10.0).alias("bag_mass_kg"), F.lit(2).alias("number_of_bags"), actor))
    feed("contexts", done("bags").crossJoin(F.broadcast(option)).select(  # one row
        F.col("pellet_bag_code").alias("request_id"), at, "pellet_bag_code", option["partner_code"], "machine_code",
        F.lit(CHAIN_DAY).alias("date_yymmdd"), actor))
    feed("conversion_hows", done("contexts").select(
        F.col("context_code").alias("request_id"), at, "context_code", text("process_code"), F.lit(CHAIN_CODE).alias("processing_code"),
        F.lit("save").alias("submit_action"), text("failure_mode"), text("machine_setup_url"), text("processed_data_url"), actor))
    feed("products", done("conversion_hows").select(
        F.col("conversion1_how_code").alias("request_id"), at, "conversion1_how_code", F.lit(1).alias("number_of_records"), actor))
    code = F.coalesce("product_code", "conversion1_how_code", "context_code", "pellet_bag_code", "processing_code", "location_id",
                      F.concat_ws(" ", "set_code", "weight_code", "batch_variant_code"))
    return T.read_outcomes(spark, f"{work}/state").where("outcome = 'created'").select("kind", code.alias("code"))


@query
def stream_register_weights(spark, sf_dir):
    """T1 for dry weights (codes numbered per set scope across micro-batches)."""
    t = domain(spark, sf_dir)
    out = _stream_in_arrivals(spark, t, "weights", t.req_weights, "weights")
    return out.select("request_id", (F.col("outcome") != "rejected").alias("accepted"), "set_code", "weight_code",
                      "rule")


# ---- sources, schema checks, lookups, paging variants -------------------------------------


@query
def archived_backfill(spark, sf_dir):
    """Migration backfill archived NULL -> FALSE, counted per value."""
    b = S.backfill(domain(spark, sf_dir).ingredient_batches, "archived", False)
    return b.groupBy("archived").agg(F.count(F.lit(1)).alias("n"))


@query
def schema_problems(spark, sf_dir):
    """Every stored table checked against its column contract (no problems expected)."""
    t = domain(spark, sf_dir)
    return S.require_schema(spark, {n: t[n] for n in S.SCHEMAS})


@query
def schema_file_problems(spark, sf_dir):
    """S6 on files: partners stored in four part files, three of which drifted (a column less, one of
    another type, one more), and a table that is not there."""
    rows = domain(spark, sf_dir).location_partners.coalesce(1)
    root = f"{checkpoint_dir(spark).rstrip('/')}/drift-{uuid.uuid4().hex}"
    for part in (rows, rows.drop("machine_specification"), rows.withColumn("created_at", F.col("created_at").cast("string")),
                 rows.withColumn("region", F.lit("EU"))):
        part.write.mode("append").parquet(f"{root}/location_partners")
    found = S.file_problems(spark, root, ["location_partners", "user_roles"])
    return found.groupBy("table_name", "column_name", "problem", "expected", "found").agg(F.count("file").alias("files"))


@query
def appended_batches(spark, sf_dir):
    """S3: locations appended in one plain and two numbered batches, the last of them sent twice, and
    read back."""
    locs = domain(spark, sf_dir).location_codes
    root = f"{checkpoint_dir(spark).rstrip('/')}/append-{uuid.uuid4().hex}"
    part = F.pmod(F.crc32("location_id"), F.lit(3))
    S.append(locs.where(part == 0), root, "location_codes")
    for batch in (1, 2, 2):
        S.append_batch(locs.where(part == batch), root, "location_codes", batch)
    return S.read_table(spark, root, "location_codes").select("location_id", "partner_code", "created_at")


@query
def changed_snapshots(spark, sf_dir):
    """R4 + R11 as commits: bags patched, then sets and their items deleted together, all read back."""
    t = domain(spark, sf_dir)
    root = f"{checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    make = functools.partial(TableStore, base=t)

    def patched(s):
        return {"pellet_bags": (REPLACE, CH.patch_bags(s.pellet_bags, t.chg_bags.drop("pellet_bag_code"), AS_OF, ["pellet_bag_id"])[0])}

    def registered(s):
        _, _, new = M.register_sets(t.req_sets, s, AS_OF)
        return {n: (APPEND, new[n]) for n in ("ingredient_sets", "ingredient_set_items")}

    def deleted(s):
        codes = s.ingredient_sets.select("set_code")
        deps = A.dependency_counts(s.dry_weight_variants, s.batch_variants, s.location_codes)
        sets, items, _ = CH.delete_sets(s.ingredient_sets, s.ingredient_set_items, codes, deps)
        return {"ingredient_sets": (REPLACE, sets), "ingredient_set_items": (REPLACE, items)}

    for change in (patched, registered, deleted):
        change_tables(spark, root, change, make=make)
    now = make(spark, root)
    bags = now.pellet_bags.select(F.lit("bag").alias("part"), F.col("pellet_bag_id").alias("key"), "updated_by",
                                  F.col("remaining_mass_kg").alias("value"))
    items = now.ingredient_set_items.groupBy("set_code").agg(F.count(F.lit(1)).cast("double").alias("value"))
    sets = now.ingredient_sets.join(items, "set_code").select(F.lit("set").alias("part"), F.col("set_code").alias("key"),
                                                              F.lit(None).cast("string").alias("updated_by"), "value")
    return bags.unionByName(sets)


@query
def weights_of_set(spark, sf_dir):
    """L2: the weight variants of one set."""
    w = LN.weights_of_set(domain(spark, sf_dir), "S1")
    return w.select("set_code", "weight_code", "weight_hash", V.pairs_text("items", "sku", "wt_percent").alias("items_text"))


@query
def variants_of_weight(spark, sf_dir):
    """L3: the batch variants of one (set, weight)."""
    v = LN.variants_of_weight(domain(spark, sf_dir), "S1", "AB")
    return v.select("set_code", "weight_code", "batch_variant_code", V.pairs_text("items", "sku", "ingredient_batch_code").alias("items_text"))


@query
def role_list(spark, sf_dir):
    """Stored roles."""
    return LN.lookup_list(domain(spark, sf_dir), spark, "roles")


@query
def failure_mode_list(spark, sf_dir):
    """Failure modes, with the number of active compounding hows that have each."""
    t = domain(spark, sf_dir)
    used = t.compounding_how.where("is_active").groupBy("failure_mode").agg(F.count(F.lit(1)).alias("n_hows"))
    return LN.lookup_list(t, spark, "failure_modes").join(used, "failure_mode", "left").fillna({"n_hows": 0})


@query
def formulation_codes_fallback(spark, sf_dir):
    """Formulation codes from the base table when the view is unavailable."""
    return A.distinct_formulations_from(None, domain(spark, sf_dir).batch_variants)


@query
def active_role_count(spark, sf_dir):
    """A8."""
    return A.active_role_count(domain(spark, sf_dir).user_roles)


@query
def assignee_list(spark, sf_dir):
    """Active assignees."""
    return LN.lookup_list(domain(spark, sf_dir), spark, "assignees")


@query
def set_list(spark, sf_dir):
    """Full set list with SKUs."""
    s = LN.lookup_list(domain(spark, sf_dir), spark, "sets")
    return s.select("set_code", F.array_join("sku_list", ",").alias("sku_list_text"), "notes", "material_workstream")


SET_Q = "_00"


@query
def sets_page(spark, sf_dir):
    """L1: sets whose code or any SKU contains '_00' (J9), page 2 of 50, newest first."""
    s = J.sets_matching(V.sets(domain(spark, sf_dir)), SET_Q)
    rows, _ = O.page(s, "sets", 2, PAGE_SIZE)
    return rows.select("set_code", "created_at", F.array_join("sku_list", ",").alias("sku_list_text"))


KEYSET_AFTER = {"created_at": "1998-06-01 00:00:00", "set_code": "MM", "weight_code": "MM",
                "batch_variant_code": "MM"}


@query
def formulations_keyset(spark, sf_dir):
    """O2 keyset: the 50 formulations after a fixed listing key (newest first)."""
    return render_formulations(LN.formulations_after(domain(spark, sf_dir), KEYSET_AFTER, PAGE_SIZE))


@query
def existing_batches(spark, sf_dir):
    """The requested (sku, batch) pairs of every batch-variant request that are
    stored batches."""
    t = domain(spark, sf_dir)
    pairs = t.req_variants.select(F.explode("items").alias("i")).select("i.sku", "i.ingredient_batch_code")
    found, _ = J.existing_batches(pairs, t.ingredient_batches)
    return found


@query
def display_functions(spark, sf_dir):
    """F7-F27 over every compounding how joined to its location: display and check columns."""
    t = domain(spark, sf_dir)
    h = t.compounding_how.join(t.location_codes.select(F.col("location_id").alias("location_code"),
                                                       "production_date", "partner_code"), "location_code", "left")
    return h.select(
        "processing_code",
        TX.collapse_ws(F.concat(F.lit("  "), F.col("processing_code"), F.lit("   x"))).alias("collapsed"),
        TX.is_yymmdd("production_date").alias("is_yymmdd"),
        TX.yymmdd_label("production_date").alias("date_label"),
        TX.ts_display("created_at").alias("created_display"),
        TX.is_allowed_link("machine_setup_url").alias("setup_link_ok"),
        TX.is_allowed_link("processed_data_url").alias("data_link_ok"),
        TX.safe_filename("machine_setup_url").alias("setup_file"),
        TX.default_text("created_by").alias("owner"),
        TX.normalize_email("created_by").alias("owner_email"),
        C.is_two_letter_code("partner_code").alias("partner_ok"),
        C.token("processing_code", 5).alias("suffix_token"))


@query
def quality_unique_keys(spark, sf_dir):
    """Header keys that must be unique (weight variants, batch variants, sets)."""
    t = domain(spark, sf_dir)
    w = Q.check_unique(t.dry_weight_variants, ["set_code", "weight_code"], "dry_weight_variants")
    b = Q.check_unique(t.batch_variants, ["set_code", "weight_code", "batch_variant_code"], "batch_variants")
    s = Q.check_unique(t.ingredient_sets, ["set_code"], "ingredient_sets")
    cols = ["set_code", "weight_code", "batch_variant_code", "n", "rule", "message"]
    return w.unionByName(b, allowMissingColumns=True).unionByName(s, allowMissingColumns=True).select(*cols)


@query
def stream_register_variants(spark, sf_dir):
    """T1 for batch variants (codes numbered per (set, weight) scope across micro-batches)."""
    t = domain(spark, sf_dir)
    out = _stream_in_arrivals(spark, t, "variants", t.req_variants, "variants")
    return out.select("request_id", (F.col("outcome") != "rejected").alias("accepted"), "set_code", "weight_code",
                      "batch_variant_code", "rule")


from batchtrace.plans import catalog_kept  # noqa: E402, F401  (registers its queries)
