"""Lineage and composite queries (L5-L18) in bulk form.

The reference answers one code per request; here every query answers all keys at
once (or the keys in a requested frame) in one plan. Detail pages that list children
(bags of a how, formulations of a bag, batch candidates of a SKU) are returned in
long form, one row per (parent, child), so no parent is collected into an array and a
parent holding a third of all children still spreads over many tasks.

``t`` is any table set indexable by table name (e.g. ``sources.tpch.domain``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from batchtrace.functions import codes as C, text as TX
from batchtrace.operators import aggregates as A, filters as P, joins as J, paging as O
from batchtrace.plans import views as V
from batchtrace.sources import registries as R

FORM_KEYS = ["set_code", "weight_code", "batch_variant_code"]


def formulations_search(t, filters: dict | None = None, sku: str | None = None, exact: bool = False) -> DataFrame:
    """L4 filters: equality on codes (P2) and a SKU filter. The faithful SKU filter is a
    case-insensitive substring of the JSON text of the SKU list (K4: '1_2' also hits
    '1_20'); ``exact`` matches whole SKUs instead."""
    f = P.filter_eq(V.formulations(t), filters or {})
    if sku:
        if exact:
            f = f.where(F.array_contains("sku_list", sku))
        else:
            f = f.where(P.contains_ci(TX.json_text("sku_list"), sku))
    return f


def _headers(t, filters: dict | None = None) -> DataFrame:
    """Formulation headers that have items (the inner join of L3), without their items."""
    return P.filter_eq(t["batch_variants"], filters or {}).join(t["batch_variant_items"].select(*FORM_KEYS), FORM_KEYS, "left_semi")


def _fetch(t, headers: DataFrame) -> DataFrame:
    """L4 of a page of headers: their items and weights only. A page has at most
    ``R.MAX_PAGE_SIZE`` rows, so its keys are broadcast and the item tables are not shuffled."""
    keys = F.broadcast(headers.select(*FORM_KEYS))
    weights = F.broadcast(headers.select("set_code", "weight_code").distinct())
    return V.formulations({
        "batch_variants": headers, "batch_variant_items": t["batch_variant_items"].join(keys, FORM_KEYS, "left_semi"),
        **{n: t[n].join(weights, ["set_code", "weight_code"], "left_semi") for n in ("dry_weight_variants", "dry_weight_items")}})


#: Header rows that a page may be cut from on the driver; deeper pages join all headers with their items.
MAX_CUT = 10_000


def _page_headers(t, filters: dict | None, first: int, size: int, last_key: dict | None = None) -> DataFrame:
    """Headers ``first`` to ``first + size`` (of those with items) in listing order. Headers are taken
    first and those without items dropped, with more taken if that leaves too few; so the item table
    is scanned for the keys of a few headers, not shuffled."""
    heads = P.filter_eq(t["batch_variants"], filters or {})
    spec = O.SORT_SPECS["formulations"]
    spark, take = heads.sparkSession, first + 2 * size
    while take <= MAX_CUT:
        top = O.after(heads, spec, last_key).orderBy(*O.order_cols(spec)).limit(take).collect()
        keys = F.broadcast(spark.createDataFrame(top, heads.schema).select(*FORM_KEYS).distinct())  # at most MAX_CUT rows
        filled = {tuple(r) for r in t["batch_variant_items"].select(*FORM_KEYS).join(keys, FORM_KEYS, "left_semi").distinct().collect()}
        found = [r for r in top if tuple(r[k] for k in FORM_KEYS) in filled]
        if len(found) >= first + size or len(top) < take:
            return spark.createDataFrame(found[first:first + size], heads.schema)
        take *= 2
    rows = O.after(_headers(t, filters), spec, last_key).orderBy(*O.order_cols(spec))
    return rows.offset(first).limit(size)


def formulations_page(t, filters=None, sku=None, page_no=1, size=None):
    """L4 + O2: newest first with code tie-breakers, plus the filtered total. Without a SKU
    filter the page is cut from the headers and only its own items and weights are fetched."""
    if sku:
        return O.page(formulations_search(t, filters, sku), "formulations", page_no, size)
    page_no, size = O.clamp_page(page_no, size)
    return _fetch(t, _page_headers(t, filters, (page_no - 1) * size, size)), O.total(_headers(t, filters))


def formulations_after(t, last_key: dict | None, size=None, filters: dict | None = None) -> DataFrame:
    """L4 + O2 keyset: the page after ``last_key``, fetched like ``formulations_page``."""
    return _fetch(t, _page_headers(t, filters, 0, O.clamp_page(1, size)[1], last_key))


def _codes(t) -> DataFrame:
    """Header columns that the where-used listings show."""
    return t["batch_variants"].select(*FORM_KEYS, C.base_code(*FORM_KEYS).alias("base_code"), "created_at")


def formulations_by_batch(t, pairs: DataFrame | None = None) -> DataFrame:
    """L5 (J10): for each requested (sku, batch) pair - by default every stored batch -
    the formulations whose batch items use it."""
    pairs = pairs if pairs is not None else t["ingredient_batches"]
    return J.using_batch(t["batch_variant_items"], pairs).join(_codes(t), FORM_KEYS)


def sku_summary_formulations(t, skus: DataFrame | None = None) -> DataFrame:
    """L6 part 1 (J7, case-sensitive): formulations containing each SKU."""
    skus = skus if skus is not None else t["ingredients"].select("sku")
    return J.using_sku(t["batch_variant_items"], skus).join(_codes(t), FORM_KEYS)


def sku_summary_bags(t, skus: DataFrame | None = None) -> DataFrame:
    """L6 part 2 (J6 + J8): active bags whose how's location tokens name a formulation
    containing the SKU (case-insensitive). The how is not filtered to active here (K8)."""
    skus = skus if skus is not None else t["ingredients"].select("sku")
    bags = P.active(t["pellet_bags"]).select("pellet_bag_id", "pellet_bag_code", "compounding_how_code",
                                             "updated_at", "created_at")
    used = J.using_sku(t["batch_variant_items"], skus, ignore_case=True).join(_codes(t).select(*FORM_KEYS), FORM_KEYS, "left_semi")
    recipes = used.groupBy(*FORM_KEYS).agg(F.collect_set("requested_sku").alias("_skus"))  # the SKUs of one recipe
    # equal rows are dropped on both sides, so the many (SKU, bag) rows that they make are distinct as they are;
    # bags and recipes are dealt out by how once, a recipe as one row
    hows = t["compounding_how"].select(F.col("processing_code").alias("compounding_how_code"), "location_code")
    by_how = J.hows_to_formulations(hows, recipes).select("compounding_how_code", "_skus").repartition("compounding_how_code")
    by_how = by_how.groupBy("compounding_how_code").agg(F.array_distinct(F.flatten(F.collect_list("_skus"))).alias("_skus"))
    by_how = by_how.select("compounding_how_code", F.explode("_skus").alias("requested_sku"))
    return bags.repartition("compounding_how_code").distinct().join(by_how, "compounding_how_code").select(
        "requested_sku", "pellet_bag_id", "pellet_bag_code", "compounding_how_code", "updated_at", "created_at")


def _latest_locations(t) -> DataFrame:
    """Location ids may repeat; keep the newest row per id."""
    return O.first_per_key(t["location_codes"], ["location_id"], [("created_at", True)])


def _partner_registry(t, spark) -> DataFrame:
    """Custom partners replace default partners with the same code (tens of rows)."""
    custom = t["location_partners"].select("partner_code", "partner_name", "machine_specification")
    return J.overlay(custom, R.partner_seeds(spark), "partner_code")


def bag_detail(t) -> DataFrame:
    """L7 (J5): every active bag with its active how, location and custom partner
    (three left joins), then its formulations via the how's location tokens (J6).
    One row per (bag, formulation); bags without a formulation keep one row."""
    bags = P.active(t["pellet_bags"])
    hows = P.active(t["compounding_how"]).select(
        F.col("processing_code").alias("compounding_how_code"), "location_code", "failure_mode",
        "machine_setup_url", "processed_data_url")
    locs = _latest_locations(t).select(F.col("location_id").alias("location_code"),
                                       F.col("partner_code").alias("location_partner_code"))
    partners = t["location_partners"].select(F.col("partner_code").alias("location_partner_code"),
                                             F.col("partner_name").alias("compounding_partner_name"),
                                             F.col("machine_specification").alias("_machine"))
    d = (bags.join(hows, "compounding_how_code", "left")
         .join(locs, "location_code", "left")
         .join(partners, "location_partner_code", "left")
         .withColumn("machine", F.coalesce(F.col("_machine"), F.col("location_partner_code")))
         .drop("_machine"))
    forms = V.formulations(t).select(*FORM_KEYS, "base_code")
    tok = J.location_tokens(d)
    f = forms.select(F.col("set_code").alias("_set"), F.col("weight_code").alias("_weight"),
                     F.col("batch_variant_code").alias("_variant"), F.col("base_code").alias("formulation_base_code"))
    return tok.join(f, ["_set", "_weight", "_variant"], "left").drop("_set", "_weight", "_variant")


def how_detail(t) -> DataFrame:
    """Every active compounding how with its active bags (one row per bag; a how
    without bags keeps one row with NULL bag columns)."""
    hows = P.active(t["compounding_how"]).select(
        "processing_code", "location_code", "process_code_suffix", "failure_mode", "notes", "created_at")
    bags = P.active(t["pellet_bags"]).select(
        F.col("compounding_how_code").alias("processing_code"), "pellet_bag_id", "pellet_bag_code",
        "product_type", "bag_mass_kg", "remaining_mass_kg", F.col("created_at").alias("bag_created_at"))
    return J.skew_safe_left_join(hows, bags, ["processing_code"])


def batch_selection_detail(t, base_codes: DataFrame | None = None) -> DataFrame:
    """L9 (F12, O5, J14): base code -> formulation -> location codes -> active hows ->
    active bags, as one left-joined chain. ``base_codes`` (column ``base_code``) defaults
    to every formulation; codes that do not parse to three tokens are dropped."""
    forms = V.formulations(t)
    cols = [*FORM_KEYS, "base_code", F.col("created_at").alias("formulation_created_at")]
    if base_codes is None:
        f = forms.select(*cols)
    else:
        from batchtrace.functions.codes import parse_base_code
        req = base_codes.select(parse_base_code("base_code").alias("_p")).where("_p IS NOT NULL") \
                        .select("_p.*").distinct()
        f = req.join(forms.select(*cols), FORM_KEYS, "left")
    locs = t["location_codes"].select(*FORM_KEYS, "location_id", "partner_code", "production_date")
    hows = P.active(t["compounding_how"]).select(F.col("location_code").alias("location_id"), "processing_code")
    bags = P.active(t["pellet_bags"]).select(F.col("compounding_how_code").alias("processing_code"),
                                             "pellet_bag_code", "bag_mass_kg")
    # From the far end: a hop's left input, read twice (matched + unmatched rows), is a table, and
    # the chain so far has all keys of the table it began with, so it is read once.
    chain = J.skew_safe_left_join(hows, bags, ["processing_code"])
    chain = J.skew_safe_left_join(locs, chain, ["location_id"], hows)
    return J.skew_safe_left_join(f, chain, FORM_KEYS, locs)


def location_rows(t, spark, q: str | None = None) -> DataFrame:
    """L10 rows: location codes (P4 on the id) with partner labels from the overlay
    registry (J15 + J16)."""
    locs = P.project(P.search_contains(t["location_codes"], "location_id", q), "location_codes")
    return J.with_partner(locs, _partner_registry(t, spark))


def context_rows(t, q: str | None = None) -> DataFrame:
    """L11 rows: active contexts (P4 on the code) with the coalesced partner label."""
    ctx = P.search_contains(P.active(t["conversion1_context"]), "context_code", q)
    return J.context_labels(ctx, t["location_partners"])


def compounding_how_rows(t, q: str | None = None) -> DataFrame:
    """Active compounding hows, LIKE on the code or the suffix (P3), listing columns (P1),
    newest first."""
    rows = P.search_like(P.active(t["compounding_how"]), ["processing_code", "process_code_suffix"], q)
    return O.sort_listing(P.project(rows, "compounding_how"), "compounding_how")


def weights_of_set(t, set_code: str) -> DataFrame:
    """L2: weight variants of one set, by weight code."""
    return V.weights(t).where(F.col("set_code") == set_code).orderBy("weight_code")


def variants_of_weight(t, set_code: str, weight_code: str) -> DataFrame:
    """L3: batch variants of one (set, weight), by variant code."""
    v = V.variants(t).where((F.col("set_code") == set_code) & (F.col("weight_code") == weight_code))
    return v.orderBy("batch_variant_code")


def sku_summary_ingredient(t, skus: DataFrame) -> DataFrame:
    """The ingredient rows of the requested SKUs (case-insensitive), newest first."""
    want = skus.select(F.lower("sku").alias("_sku")).distinct()
    rows = t["ingredients"].withColumn("_sku", F.lower("sku")).join(want, "_sku", "left_semi").drop("_sku")
    return rows.orderBy(F.col("created_at").desc_nulls_last())


def batches_of_sku(t, sku: str, include_archived: bool = False) -> DataFrame:
    """Batches of one SKU, by batch code."""
    return batch_rows(t, sku, include_archived).orderBy("ingredient_batch_code")


def conversion_how_rows(t, q: str | None = None) -> DataFrame:
    """Active conversion hows, P4 on the code."""
    return P.project(P.search_contains(P.active(t["conversion1_how"]), "conversion1_how_code", q), "conversion1_how")


def product_rows(t, how_code: str | None = None, q: str | None = None) -> DataFrame:
    """Active products, both filters optional (P2 + P4)."""
    p = P.active(t["conversion1_products"])
    p = P.search_contains(p, "conversion1_how_code", how_code)
    return P.search_contains(p, "product_code", q)


def bag_rows(t, q: str | None = None) -> DataFrame:
    """Active bags, LIKE on the lower-cased code (P3), listing columns (P1), newest first."""
    return O.sort_listing(P.project(P.search_like(P.active(t["pellet_bags"]), ["pellet_bag_code"], q), "pellet_bags"), "pellet_bags")


def ingredient_rows(t, q: str | None = None, filters: dict | None = None) -> DataFrame:
    """Ingredient search: LIKE over sku, trade name, supplier (P3) + equality filters."""
    return P.filter_eq(P.search_like(t["ingredients"], ["sku", "trade_name_inci", "supplier"], q), filters or {})


def batch_rows(t, sku: str | None = None, include_archived: bool = False) -> DataFrame:
    """Batches (P2 + P6)."""
    return P.not_archived(P.filter_eq(t["ingredient_batches"], {"sku": sku}), include_archived)


def status_queue(t, status_col: str, limit: int = R.DASHBOARD_QUEUE_SIZE) -> DataFrame:
    """Newest open items of one status stream (P7, P11, F20, O3). Top-N keeps the
    whole table out of the sort: each task ships only its local top ``limit`` rows."""
    q = P.status_queue(t["pellet_bags"], status_col)
    order = [F.coalesce("updated_at", "created_at").desc(), F.col("pellet_bag_code").desc()]
    return O.top_n(q, order, limit)


def dashboard_kpis(t) -> DataFrame:
    """L14."""
    return A.dashboard_kpis(t["ingredients"], t["pellet_bags"])


def lookup_list(t, spark, name: str) -> DataFrame:
    """Dropdown lists."""
    if name == "formulation_codes":
        return A.distinct_formulations(V.formulations(t))
    if name == "partners":
        return _partner_registry(t, spark)
    if name == "partner_machine_options":
        p = t["location_partners"]
        return p.select("partner_code", "partner_name", F.col("machine_specification").alias("machine_code"),
                        TX.option_key("partner_code", "machine_specification").alias("option_key"),
                        TX.partner_machine_label("partner_name", "machine_specification").alias("label")) \
                .where("option_key IS NOT NULL")
    if name == "conversion_how_codes":
        h = P.active(t["conversion1_how"]).select("conversion1_how_code").distinct()
        return h.orderBy(F.col("conversion1_how_code").desc())
    if name == "compounding_how_codes":
        return P.active(t["compounding_how"]).select("processing_code").distinct().orderBy(F.col("processing_code").desc())
    if name == "location_ids":
        return t["location_codes"].select("location_id").distinct().orderBy("location_id")
    if name == "assignees":
        return P.active(t["pellet_bag_assignees"]).select("email")
    if name == "roles":
        return t["user_roles"].select("email", "role_group", "is_active")
    if name == "failure_modes":
        return spark.createDataFrame([(m,) for m in R.FAILURE_MODES], "failure_mode string")
    if name == "sets":
        return V.sets(t).select("set_code", "sku_list", "notes", "material_workstream")
    if name == "bag_codes":
        return P.distinct_nonblank(P.active(t["pellet_bags"]), "pellet_bag_code")
    raise ValueError(name)


def recipe_lines(t, show_weights: bool = True) -> DataFrame:
    """L16 (N4): one display row per SKU position of every formulation, with its batch
    and aligned weight (missing -> ''), percent text (F14), timestamp text (F13) and
    owner default (F27). A recipe with no SKUs gives one row with SKU '—'."""
    f = V.formulations(t)
    e = f.select(*FORM_KEYS, "base_code", "created_at", "created_by", "batch_items", "dry_weight_items",
                 F.posexplode_outer("sku_list").alias("position", "sku"))
    batch = F.get(F.filter("batch_items", lambda x: x["sku"] == F.col("sku")), 0)["ingredient_batch_code"]
    wt = F.get(F.col("dry_weight_items"), F.col("position"))["wt_percent"]
    out = e.select(*FORM_KEYS, "base_code",
                   F.coalesce("position", F.lit(0)).alias("position"),
                   F.coalesce("sku", F.lit("—")).alias("sku"),
                   F.coalesce(batch, F.lit("")).alias("ingredient_batch_code"),
                   TX.ts_display("created_at").alias("created_display"),
                   TX.default_text("created_by").alias("owner"),
                   (TX.percent_display(wt) if show_weights else F.lit("")).alias("wt_display"))
    return out


def weight_matrix(t, sparse: bool = True) -> DataFrame:
    """Per set, one row per weight variant with its cells aligned to the set's SKU
    columns (sparse: filled cells only; dense: one cell per column)."""
    f = A.sku_matrix_sparse if sparse else A.sku_matrix
    return f(V.weights(t), ["set_code", "weight_code"], "wt_percent", ["set_code"])


def batch_matrix(t, sparse: bool = True) -> DataFrame:
    """Per (set, weight), one row per batch variant with batch-code cells."""
    f = A.sku_matrix_sparse if sparse else A.sku_matrix
    return f(V.variants(t), FORM_KEYS, "ingredient_batch_code", ["set_code", "weight_code"])


def matrix_columns(t, kind: str) -> DataFrame:
    """The column (SKU) list of each weight matrix (per set) or batch matrix (per set, weight)."""
    if kind == "weight":
        return A.matrix_columns(V.weights(t), ["set_code"])
    return A.matrix_columns(V.variants(t), ["set_code", "weight_code"])


def batch_candidates(t) -> DataFrame:
    """L18 (J19): the live (active, not archived) batches that can fill each SKU used by
    any weight variant, one row per (SKU, batch), with the number of weight variants
    using the SKU; a used SKU without a live batch keeps one row with a NULL batch.

    The reference asks per SKU of one variant; the bulk form lists candidates once per
    SKU instead of once per (variant, SKU), so a SKU used by many recipes does not
    multiply its batch list (join the variant's SKUs to this frame to render one
    variant)."""
    used = V.weights(t).select(F.explode("items").alias("_it")).groupBy(F.col("_it.sku").alias("sku")) \
        .agg(F.count(F.lit(1)).alias("n_weight_variants"))
    live = P.not_archived(P.active(t["ingredient_batches"])).select("sku", "ingredient_batch_code")
    return J.skew_safe_left_join(used, live, ["sku"])
