"""DuckDB oracle SQL for the registered queries (see ``batchtrace.plans.catalog``).

Every statement runs over the driver's raw test tables: ``with_tables`` prepends the
projection CTEs. Nested outputs are compared as text (``sku=value|...``).
"""

from __future__ import annotations

from batchtrace.plans.oracle_tables import code as _code, lit as _lit, with_tables
from batchtrace.sources import registries as _R
from batchtrace.sources.schemas import SCHEMAS as _SCHEMAS

# ---- view bodies ---------------------------------------------------------------------
V_SETS = """
SELECT s.set_code, s.set_hash, s.created_at, s.created_by, s.notes, s.material_workstream,
       list(i.sku ORDER BY i.sku) AS sku_list
FROM ingredient_sets s JOIN ingredient_set_items i ON i.set_code = s.set_code
GROUP BY s.set_code, s.set_hash, s.created_at, s.created_by, s.notes, s.material_workstream"""

V_WEIGHTS = """
SELECT v.set_code, v.weight_code, v.weight_hash, v.created_at, v.created_by,
       list({'sku': i.sku, 'wt_percent': i.wt_percent} ORDER BY i.sku, i.wt_percent) AS items
FROM dry_weight_variants v
JOIN dry_weight_items i ON i.set_code = v.set_code AND i.weight_code = v.weight_code
GROUP BY v.set_code, v.weight_code, v.weight_hash, v.created_at, v.created_by"""

V_BATCHES = """
SELECT v.set_code, v.weight_code, v.batch_variant_code, v.batch_hash, v.created_at, any_value(v.created_by) AS created_by,
       list({'sku': i.sku, 'ingredient_batch_code': i.ingredient_batch_code}
            ORDER BY i.sku, i.ingredient_batch_code) AS items
FROM batch_variants v
JOIN batch_variant_items i ON i.set_code = v.set_code AND i.weight_code = v.weight_code
                          AND i.batch_variant_code = v.batch_variant_code
GROUP BY v.set_code, v.weight_code, v.batch_variant_code, v.batch_hash, v.created_at, v.created_by"""

V_FLAT = f"""
SELECT b.set_code, b.weight_code, b.batch_variant_code,
       b.set_code || ' ' || b.weight_code || ' ' || b.batch_variant_code AS base_code,
       b.created_at, b.created_by, b.sku_list, len(b.sku_list) AS sku_count, b.batch_items,
       list_transform(b.sku_list, lambda s: {{'sku': s,
           'wt_percent': list_filter(w.items, lambda x: x.sku = s)[1].wt_percent}}) AS dry_weight_items
FROM (SELECT v.*, list_transform(v.items, lambda x: x.sku) AS sku_list, v.items AS batch_items
      FROM ({V_BATCHES}) v) b
LEFT JOIN ({V_WEIGHTS}) w ON w.set_code = b.set_code AND w.weight_code = b.weight_code"""


def views_with(sql: str) -> str:
    """Add the view CTEs a query names (v_sets, v_weights, v_batches, v_flat)."""
    defs = []
    for name, body in (("v_sets", V_SETS), ("v_weights", V_WEIGHTS), ("v_batches", V_BATCHES),
                       ("v_flat", V_FLAT)):
        if name in sql:
            defs.append(f"{name} AS ({body.strip()})")
    if not defs:
        return with_tables(sql)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return with_tables("WITH " + ",\n".join(defs) + ",\n" + sql[5:])
    return with_tables("WITH " + ",\n".join(defs) + "\n" + sql)


def pairs(items: str, a: str, b: str) -> str:
    return (f"array_to_string(list_transform({items}, lambda x: x.{a} || '=' || "
            f"coalesce(CAST(x.{b} AS VARCHAR), '')), '|')")


def skus(items: str) -> str:
    return f"array_to_string({items}, ',')"


SQL: dict[str, str] = {}
SQL_BODY: dict[str, str] = {}  # without the projection, for queries that build on another


def register(name: str, sql: str) -> None:
    SQL_BODY[name] = sql
    SQL[name] = views_with(sql)


register("sets_view", f"""
SELECT set_code, set_hash, created_at, created_by, notes, material_workstream,
       {skus('sku_list')} AS sku_list_text, len(sku_list) AS sku_count
FROM v_sets""")

register("weight_variants", f"""
SELECT set_code, weight_code, weight_hash, created_at, created_by,
       {pairs('items', 'sku', 'wt_percent')} AS items_text
FROM v_weights""")

register("batch_variants", f"""
SELECT set_code, weight_code, batch_variant_code, batch_hash, created_at, created_by,
       {pairs('items', 'sku', 'ingredient_batch_code')} AS items_text
FROM v_batches""")

register("formulations_flat", f"""
SELECT set_code, weight_code, batch_variant_code, base_code, created_at, created_by, sku_count,
       {skus('sku_list')} AS sku_list_text,
       {pairs('batch_items', 'sku', 'ingredient_batch_code')} AS batch_items_text,
       {pairs('dry_weight_items', 'sku', 'wt_percent')} AS dry_weight_items_text
FROM v_flat""")


# ---- search, paging, lineage ---------------------------------------------------------------

FLAT_TEXT = f"""set_code, weight_code, batch_variant_code, base_code, created_at, created_by, sku_count,
       {skus('sku_list')} AS sku_list_text,
       {pairs('batch_items', 'sku', 'ingredient_batch_code')} AS batch_items_text,
       {pairs('dry_weight_items', 'sku', 'wt_percent')} AS dry_weight_items_text"""
SKU_PRED = "contains(lower(to_json(sku_list)), '_001')"
FORM_ORDER = ("created_at DESC NULLS LAST, set_code DESC NULLS LAST, weight_code DESC NULLS LAST, "
              "batch_variant_code DESC NULLS LAST")
SEEDS = "(VALUES " + ", ".join(f"({_lit(c)}, {_lit(n)}, '')" for c, n in _R.DEFAULT_PARTNERS) + \
        ") AS s(partner_code, partner_name, machine_specification)"
REGISTRY = f"""(SELECT partner_code, partner_name, machine_specification FROM location_partners
  UNION ALL SELECT * FROM {SEEDS} WHERE s.partner_code NOT IN (SELECT partner_code FROM location_partners))"""
TOK = "string_split({0}, ' ')[{1}]"

register("formulations_search", f"SELECT {FLAT_TEXT} FROM v_flat WHERE {SKU_PRED}")
register("formulations_page", f"SELECT {FLAT_TEXT} FROM v_flat ORDER BY {FORM_ORDER} LIMIT 50 OFFSET 100")
register("formulations_total", f"""
SELECT count(*) AS total, TRUE AS has_prev, 150 < count(*) AS has_next, 3 AS page, 50 AS page_size
FROM v_flat WHERE {SKU_PRED}""")
register("formulations_by_batch", """
SELECT DISTINCT p.sku, p.ingredient_batch_code, f.set_code, f.weight_code, f.batch_variant_code, f.base_code,
       f.created_at
FROM (SELECT f.*, unnest(f.batch_items) AS bi FROM v_flat f) f
JOIN (SELECT DISTINCT sku, ingredient_batch_code FROM ingredient_batches) p
  ON p.sku = f.bi.sku AND p.ingredient_batch_code = f.bi.ingredient_batch_code""")
register("sku_summary_formulations", """
SELECT DISTINCT i.sku AS requested_sku, f.set_code, f.weight_code, f.batch_variant_code, f.base_code, f.created_at
FROM ingredients i JOIN (SELECT f.*, unnest(f.sku_list) AS s FROM v_flat f) f ON f.s = i.sku""")
register("sku_summary_bags", f"""
SELECT DISTINCT i.sku AS requested_sku, p.pellet_bag_id, p.pellet_bag_code, p.compounding_how_code,
       p.updated_at, p.created_at
FROM pellet_bags p
JOIN compounding_how c ON c.processing_code = p.compounding_how_code
JOIN (SELECT f.set_code, f.weight_code, f.batch_variant_code, unnest(f.sku_list) AS s FROM v_flat f) f
  ON f.set_code = {TOK.format('c.location_code', 1)} AND f.weight_code = {TOK.format('c.location_code', 2)}
 AND f.batch_variant_code = {TOK.format('c.location_code', 3)}
JOIN ingredients i ON lower(f.s) = lower(i.sku)
WHERE p.is_active""")
register("bag_detail", f"""
SELECT p.pellet_bag_id, p.pellet_bag_code, p.compounding_how_code, c.location_code, c.failure_mode,
       lc.partner_code AS location_partner_code, lp.partner_name AS compounding_partner_name,
       coalesce(lp.machine_specification, lc.partner_code) AS machine, f.base_code AS formulation_base_code
FROM pellet_bags p
LEFT JOIN (SELECT * FROM compounding_how WHERE is_active) c ON c.processing_code = p.compounding_how_code
LEFT JOIN (SELECT * FROM location_codes
           QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY created_at DESC) = 1) lc
  ON lc.location_id = c.location_code
LEFT JOIN location_partners lp ON lp.partner_code = lc.partner_code
LEFT JOIN v_flat f ON f.set_code = {TOK.format('c.location_code', 1)}
 AND f.weight_code = {TOK.format('c.location_code', 2)} AND f.batch_variant_code = {TOK.format('c.location_code', 3)}
WHERE p.is_active""")
register("how_detail", """
SELECT c.processing_code, c.location_code, c.failure_mode, b.pellet_bag_code, b.product_type, b.bag_mass_kg
FROM (SELECT * FROM compounding_how WHERE is_active) c
LEFT JOIN (SELECT * FROM pellet_bags WHERE is_active) b ON b.compounding_how_code = c.processing_code""")
register("batch_selection_detail", """
SELECT f.base_code, l.location_id, l.partner_code, l.production_date, c.processing_code, b.pellet_bag_code
FROM v_flat f
LEFT JOIN location_codes l ON l.set_code = f.set_code AND l.weight_code = f.weight_code
 AND l.batch_variant_code = f.batch_variant_code
LEFT JOIN (SELECT * FROM compounding_how WHERE is_active) c ON c.location_code = l.location_id
LEFT JOIN (SELECT * FROM pellet_bags WHERE is_active) b ON b.compounding_how_code = c.processing_code""")
LOC_ROWS = f"""
SELECT l.location_id, l.partner_code, coalesce(nullif(r.partner_name, ''), 'Unknown') AS partner_name,
       coalesce(nullif(r.machine_specification, ''), '') AS machine_specification, l.created_at
FROM location_codes l LEFT JOIN {REGISTRY} r ON r.partner_code = l.partner_code"""
register("location_page", f"""
SELECT * FROM ({LOC_ROWS}) x WHERE contains(lower(location_id), 'aa')
ORDER BY created_at DESC NULLS LAST, location_id DESC NULLS LAST LIMIT 50""")
register("location_labels", f"SELECT location_id, partner_code, partner_name, machine_specification FROM ({LOC_ROWS}) x")
register("context_page", """
SELECT c.context_code AS conversion_code, c.created_by AS owner, c.created_at,
       coalesce(lp.partner_name, c.partner_code, '') || ' - ' || coalesce(c.machine_code, '') AS conversion_partner
FROM conversion1_context c LEFT JOIN location_partners lp ON lp.partner_code = c.partner_code
WHERE c.is_active AND contains(lower(c.context_code), ' pf ')
ORDER BY c.created_at DESC NULLS LAST, c.context_code DESC NULLS LAST LIMIT 50 OFFSET 50""")
register("conversion_how_page", """
SELECT conversion1_how_code, context_code, process_code, failure_mode, created_at FROM conversion1_how
WHERE is_active AND contains(lower(conversion1_how_code), 'ab')
ORDER BY created_at DESC NULLS LAST, conversion1_how_code DESC NULLS LAST LIMIT 50""")
register("products_page", """
SELECT product_code, conversion1_how_code, product_suffix, storage_location, tensile_rigid_status,
       tensile_films_status, created_at
FROM conversion1_products WHERE is_active AND contains(lower(product_code), '0001')
ORDER BY created_at DESC NULLS LAST, product_suffix DESC NULLS LAST, product_code DESC NULLS LAST LIMIT 200""")
register("bags_search", """
SELECT pellet_bag_id, pellet_bag_code, compounding_how_code, product_type, sequence_number, bag_mass_kg,
       remaining_mass_kg, qc_status, created_at
FROM pellet_bags WHERE is_active AND lower(pellet_bag_code) LIKE '%pf 000%'""")
register("sku_summary_ingredient", """
SELECT sku, trade_name_inci, supplier, format, created_at FROM ingredients
WHERE lower(sku) IN (SELECT lower(sku) FROM batch_variant_items)""")
register("compounding_how_page", """
SELECT processing_code, process_code_suffix, failure_mode, location_code, created_at FROM compounding_how
WHERE is_active AND (lower(processing_code) LIKE '%ab%' OR lower(process_code_suffix) LIKE '%ab%')
ORDER BY created_at DESC NULLS LAST, processing_code DESC NULLS LAST LIMIT 50""")
register("conversion_how_codes", "SELECT DISTINCT conversion1_how_code FROM conversion1_how WHERE is_active")
register("compounding_how_codes", "SELECT DISTINCT processing_code FROM compounding_how WHERE is_active")
register("location_ids", "SELECT DISTINCT location_id FROM location_codes")
register("ingredients_search", """
SELECT sku, category_code, seq, pack_size_value, trade_name_inci, supplier, spec_grade FROM ingredients
WHERE (lower(sku) LIKE '%ring%' OR lower(trade_name_inci) LIKE '%ring%' OR lower(supplier) LIKE '%ring%')
  AND format = 'Powder'""")
register("batches_page", """
SELECT sku, ingredient_batch_code, archived, quantity_value, created_at FROM ingredient_batches
WHERE NOT coalesce(archived, FALSE)
ORDER BY created_at ASC NULLS FIRST, sku ASC NULLS FIRST, ingredient_batch_code ASC NULLS FIRST
LIMIT 100 OFFSET 100""")


def _queue(col: str) -> str:
    a = _R.STATUS_ASSIGNEE[col]
    who = f"coalesce({a}, created_by)" if a else "created_by"
    excluded = ", ".join(_lit(x) for x in _R.QUEUE_EXCLUDED_STATUSES)
    return f"""
SELECT pellet_bag_id, pellet_bag_code, {col} AS status_value,
       CASE WHEN trim({col}) = 'Recieved' THEN 'Received' ELSE nullif(trim({col}), '') END AS status_label,
       {who} AS assigned_to, updated_at, created_at
FROM pellet_bags
WHERE is_active AND {col} IS NOT NULL AND trim({col}) <> '' AND lower(trim({col})) NOT IN ({excluded})
ORDER BY coalesce(updated_at, created_at) DESC, pellet_bag_code DESC LIMIT 25"""


for _c in ["qc_status", "long_moisture_status", "density_status", "injection_moulding_status",
           "film_forming_status"]:
    register(f"status_queue_{_c.replace('_status', '')}", _queue(_c))

register("dashboard_kpis", """
SELECT (SELECT count(*) FROM ingredients WHERE is_active) AS sku_count,
       (SELECT count(*) FROM pellet_bags WHERE is_active) AS active_pellet_bags,
       (SELECT coalesce(sum(bag_mass_kg), 0.0) FROM pellet_bags WHERE is_active) AS total_pellets_produced_kg""")
register("dependency_counts", """
SELECT set_code, count(*) AS n, 'dry_weight_variants' AS source FROM dry_weight_variants GROUP BY set_code
UNION ALL SELECT set_code, count(*), 'batch_variants' FROM batch_variants GROUP BY set_code
UNION ALL SELECT set_code, count(*), 'location_codes' FROM location_codes GROUP BY set_code""")
register("distinct_formulations", "SELECT DISTINCT set_code, weight_code, batch_variant_code FROM v_flat")
register("partner_registry", f"SELECT * FROM {REGISTRY} r")
register("partner_machine_options", """
SELECT partner_code, partner_name, machine_specification AS machine_code,
       nullif(trim(partner_code), '') || '||' || nullif(trim(machine_specification), '') AS option_key,
       coalesce(nullif(trim(partner_name), '') || ' (' || nullif(trim(machine_specification), '') || ')',
                nullif(trim(partner_name), '')) AS label
FROM location_partners
WHERE nullif(trim(partner_code), '') || '||' || nullif(trim(machine_specification), '') IS NOT NULL""")
register("bag_code_list", """
SELECT trim(pellet_bag_code) AS pellet_bag_code FROM (
  SELECT DISTINCT pellet_bag_code FROM pellet_bags WHERE is_active AND trim(pellet_bag_code) <> '')""")


def _pct(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN CAST({x} AS DOUBLE) = floor(CAST({x} AS DOUBLE)) "
            f"THEN CAST(CAST(floor(CAST({x} AS DOUBLE)) AS BIGINT) AS VARCHAR) || '%' "
            f"ELSE printf('%.2f%%', CAST({x} AS DOUBLE)) END")


register("recipe_lines", f"""
SELECT f.set_code, f.weight_code, f.batch_variant_code, f.base_code,
       coalesce(u.pos - 1, 0) AS position, coalesce(u.sku, '—') AS sku,
       coalesce(list_filter(f.batch_items, lambda x: x.sku = u.sku)[1].ingredient_batch_code, '') AS ingredient_batch_code,
       strftime(f.created_at, '%H:%M:%S  - %d/%m/%Y') AS created_display,
       coalesce(nullif(trim(f.created_by), ''), 'Unknown') AS owner,
       {_pct('f.dry_weight_items[u.pos].wt_percent')} AS wt_display
FROM v_flat f
LEFT JOIN LATERAL (SELECT unnest(f.sku_list) AS sku, unnest(range(1, len(f.sku_list) + 1)) AS pos) u ON TRUE""")


def _cols(view: str, scope: list[str]) -> str:
    sc = ", ".join(scope)
    return (f"SELECT {sc}, list_sort(list_distinct(flatten(list(list_transform(items, lambda x: x.sku))))) AS columns "
            f"FROM {view} GROUP BY {sc}")


def _matrix(view: str, keys: list[str], scope: list[str], value: str) -> str:
    k = ", ".join(f"v.{c}" for c in keys)
    on = " AND ".join(f"c.{s} = v.{s}" for s in scope)
    return f"""
SELECT {k}, len(c.columns) AS n_columns,
       array_to_string(list_transform(
           list_filter(v.items, lambda x, i: i = len(v.items) OR v.items[i + 1].sku <> x.sku),
           lambda x: CAST(list_position(c.columns, x.sku) - 1 AS VARCHAR) || '=' ||
                     coalesce(CAST(x.{value} AS VARCHAR), '')), '|') AS cells_text
FROM {view} v JOIN ({_cols(view, scope)}) c ON {on}"""


register("weight_matrix", _matrix("v_weights", ["set_code", "weight_code"], ["set_code"], "wt_percent"))
register("batch_matrix", _matrix("v_batches", ["set_code", "weight_code", "batch_variant_code"],
                                 ["set_code", "weight_code"], "ingredient_batch_code"))
register("weight_matrix_columns", f"SELECT set_code, array_to_string(columns, ',') AS columns_text FROM ({_cols('v_weights', ['set_code'])})")
register("batch_matrix_columns", "SELECT set_code, weight_code, array_to_string(columns, ',') AS columns_text FROM ("
         + _cols("v_batches", ["set_code", "weight_code"]) + ")")
register("batch_candidates", """
SELECT u.sku, u.n_weight_variants, b.ingredient_batch_code
FROM (SELECT sku, count(*) AS n_weight_variants FROM (SELECT unnest(items).sku AS sku FROM v_weights)
      GROUP BY sku) u
LEFT JOIN (SELECT sku, ingredient_batch_code FROM ingredient_batches
           WHERE is_active AND NOT coalesce(archived, FALSE)) b ON b.sku = u.sku""")
_ci = "(CASE WHEN regexp_full_match(upper(trim({0})), '[A-Z]{{2}}') THEN " \
      "CAST((ascii(upper(trim({0}))) - 65) * 26 + ascii(substr(upper(trim({0})), 2, 1)) - 65 AS BIGINT) END)"
register("next_code_per_context", f"""
SELECT context_code, max_code, greatest(coalesce(max_code, 0), 0) + 1 AS next_value,
       CASE WHEN greatest(coalesce(max_code, 0), 0) + 1 BETWEEN 0 AND 675 THEN
         chr(CAST(65 + (greatest(coalesce(max_code, 0), 0) + 1) // 26 AS INTEGER))
         || chr(CAST(65 + (greatest(coalesce(max_code, 0), 0) + 1) % 26 AS INTEGER)) END AS next_code
FROM (SELECT context_code, max({_ci.format('processing_code')}) AS max_code FROM conversion1_how
      WHERE is_active AND processing_code IS NOT NULL GROUP BY context_code)""")
register("next_compounding_suffix", f"""
SELECT max_suffix, CASE WHEN n BETWEEN 0 AND 675 THEN chr(CAST(65 + n // 26 AS INTEGER)) || chr(CAST(65 + n % 26 AS INTEGER)) END
         AS next_suffix
FROM (SELECT max_suffix, coalesce({_ci.format('max_suffix')} + 1, 1) AS n
      FROM (SELECT max(process_code_suffix) AS max_suffix FROM compounding_how WHERE is_active))""")
register("query_cost_rollup", """
SELECT request_id, round(sum(greatest(elapsed_ms, 0.0)), 2) AS query_ms, count(*) AS query_count
FROM query_log GROUP BY request_id""")
register("parse_sku", """
WITH f AS (SELECT sku, 'current' AS form, sku AS text FROM ingredients
           UNION ALL SELECT sku, 'legacy', replace(sku, '_', '') FROM ingredients),
p AS (SELECT sku, form, text,
        CASE WHEN strpos(text, '_') > 0 THEN
               CASE WHEN len(string_split(text, '_')) = 3 THEN TRY_CAST(string_split(text, '_')[1] AS BIGINT) END
             WHEN length(text) >= 6 THEN TRY_CAST(substr(text, 1, 1) AS BIGINT) END AS c,
        CASE WHEN strpos(text, '_') > 0 THEN
               CASE WHEN len(string_split(text, '_')) = 3 THEN TRY_CAST(string_split(text, '_')[2] AS BIGINT) END
             WHEN length(text) >= 6 THEN TRY_CAST(substr(text, 2, 4) AS BIGINT) END AS s,
        CASE WHEN strpos(text, '_') > 0 THEN
               CASE WHEN len(string_split(text, '_')) = 3 THEN TRY_CAST(string_split(text, '_')[3] AS BIGINT) END
             WHEN length(text) >= 6 THEN TRY_CAST(substr(text, 6) AS BIGINT) END AS k
      FROM f)
SELECT sku, form, text, c AS category_code, s AS seq, k AS pack_size_value,
       CASE WHEN c IS NULL OR s IS NULL OR k IS NULL THEN 'sku parts must be integers' END AS error,
       printf('%d_%04d_%d', c, s, k) AS formatted
FROM p""")
register("weight_hash", """
SELECT set_code, weight_code, weight_hash, computed_hash, computed_hash = weight_hash AS matches FROM (
  SELECT set_code, weight_code, weight_hash,
         sha256(array_to_string(list_transform(items, lambda x: x.sku || '=' ||
                CAST(CAST(x.wt_percent AS DECIMAL(38,2)) AS VARCHAR)), '|')) AS computed_hash
  FROM v_weights)""")
register("set_hash_check", """
SELECT set_code, set_hash, sha256(array_to_string(sku_list, '|')) AS computed_hash FROM v_sets""")
register("misplaced_sku_repair", """
WITH b AS (SELECT set_code, 'stored' AS variant, sku_list, material_workstream FROM v_sets
           UNION ALL SELECT set_code, 'misplaced', []::VARCHAR[], array_to_string(sku_list, ', ') FROM v_sets),
t AS (SELECT *, list_filter(list_transform(string_split(coalesce(material_workstream, ''), ','), lambda x: trim(x)),
                            lambda x: x <> '') AS toks,
             list_filter(coalesce(sku_list, []::VARCHAR[]), lambda x: x IS NOT NULL AND x <> '') AS skus FROM b),
m AS (SELECT *, len(skus) = 0 AND len(toks) > 1
                AND list_bool_and(list_transform(toks, lambda x: regexp_matches(x, '\\d_\\d{4}_\\d{2}'))) AS mv FROM t)
SELECT set_code, variant, array_to_string(CASE WHEN mv THEN toks ELSE sku_list END, ',') AS sku_list_text,
       CASE WHEN mv THEN '' ELSE material_workstream END AS material_workstream
FROM m""")


# ---- registration ------------------------------------------------------------------------------

EXHAUSTED = "'code_space_exhausted' AS rule, 'no two-letter code left in this scope' AS message"


def _code_or_null(v: str) -> str:
    return f"CASE WHEN {v} BETWEEN 0 AND 675 THEN {_code(v)} END"


def _dedupe(counter: str, start: int, existing: str) -> str:
    """CTEs after ``valid(request_id, submitted_at, scope_txt, h, ...)``: resolve to existing,
    created (first per (scope, hash), numbered per scope from the counter) or duplicate."""
    return f"""
v AS (SELECT valid.*, e.code AS existing FROM valid LEFT JOIN ({existing}) e
      ON e.scope_txt = valid.scope_txt AND e.h = valid.h),
fresh AS (SELECT *, row_number() OVER (PARTITION BY scope_txt, h ORDER BY submitted_at, request_id) AS rk
          FROM v WHERE existing IS NULL),
leaders AS (SELECT *, row_number() OVER (PARTITION BY scope_txt ORDER BY submitted_at, request_id) - 1 AS pos
            FROM fresh WHERE rk = 1),
num AS (SELECT l.*, coalesce(c.next_value, {start}) + l.pos AS value FROM leaders l
        LEFT JOIN (SELECT scope, next_value FROM code_counters WHERE counter_name = '{counter}') c
        ON c.scope = l.scope_txt),
codes AS (SELECT *, {_code_or_null('value')} AS code FROM num),
dd AS (SELECT f.*, c.code AS dcode FROM fresh f LEFT JOIN codes c ON c.scope_txt = f.scope_txt AND c.h = f.h
       WHERE f.rk > 1),
results AS (SELECT request_id, 'existing' AS outcome, existing AS code, h, scope_txt FROM v WHERE existing IS NOT NULL
            UNION ALL SELECT request_id, 'created', code, h, scope_txt FROM codes WHERE code IS NOT NULL
            UNION ALL SELECT request_id, 'duplicate', dcode, h, scope_txt FROM dd WHERE dcode IS NOT NULL),
exhausted AS (SELECT request_id, {EXHAUSTED} FROM codes WHERE code IS NULL
              UNION ALL SELECT request_id, {EXHAUSTED} FROM dd WHERE dcode IS NULL)"""


def _membership(req: str, arr: str, ref: str, prefix: str, scope: list[str] | None = None) -> str:
    """Values of ``arr`` missing from ``ref(scope..., val)``, listed in request order."""
    scope = scope or []
    sc = "".join(f"{c}, " for c in scope)
    on = " AND ".join([f"r.{c} = e.{c}" for c in scope] + ["r.val = e.val"])
    return f"""
SELECT request_id, 'membership' AS rule, '{prefix}' || string_agg(val, ', ' ORDER BY pos) AS message FROM (
  SELECT e.request_id, e.val, e.pos FROM (
    SELECT request_id, {sc}unnest({arr}) AS val, unnest(range(len({arr}))) AS pos FROM {req}) e
  WHERE NOT EXISTS (SELECT 1 FROM ({ref}) r WHERE {on})) GROUP BY request_id"""


def _first(*parts: str) -> str:
    """Fail-fast: keep the first failed check per request (parts in check order)."""
    u = " UNION ALL ".join(f"SELECT request_id, rule, message, {i} AS prec FROM ({p}) AS t{i}(request_id, rule, message)"
                           for i, p in enumerate(parts))
    return f"""SELECT request_id, rule, message FROM ({u})
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY prec, message) = 1"""


def _out(codes: dict[str, str], accepted: str, rejects: str) -> str:
    cols = ", ".join(f"CAST({e} AS VARCHAR) AS {n}" for n, e in codes.items())
    nulls = ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in codes)
    return f"""
SELECT CAST(request_id AS VARCHAR) AS request_id, outcome, {cols}, CAST(NULL AS VARCHAR) AS rule,
       CAST(NULL AS VARCHAR) AS message FROM ({accepted}) a
UNION ALL
SELECT CAST(request_id AS VARCHAR), 'rejected', {nulls}, rule, message FROM ({rejects}) x"""


register("register_sets", f"""
WITH r AS (SELECT *, list_transform(skus, lambda x: trim(x)) AS s FROM req_sets),
rej AS ({_membership('r', 's', 'SELECT sku AS val FROM ingredients', 'Unknown SKUs: ')}
        UNION ALL SELECT request_id, 'empty_set', 'at least one SKU is required' FROM r WHERE len(s) = 0),
valid AS (SELECT *, '' AS scope_txt, sha256(array_to_string(list_sort(s), '|')) AS h FROM r
          WHERE request_id NOT IN (SELECT request_id FROM rej)),
{_dedupe('set_code', 1, "SELECT '' AS scope_txt, set_hash AS h, min(set_code) AS code FROM ingredient_sets GROUP BY set_hash")}
{_out({'set_code': 'code', 'set_hash': 'h'}, 'SELECT * FROM results', 'SELECT * FROM rej UNION ALL SELECT * FROM exhausted')}""")

_WITEMS = ("list_transform(items, lambda x: {'sku': trim(x.sku), "
           "'wt_percent': CAST(round(CAST(x.wt_percent AS DECIMAL(38,9)), 2) AS DECIMAL(9,2))})")
register("register_weights", f"""
WITH r AS (SELECT request_id, submitted_at, upper(trim(set_code)) AS set_code, {_WITEMS} AS items FROM req_weights),
k AS (SELECT *, list_transform(items, lambda x: x.sku) AS skus FROM r
      WHERE set_code IN (SELECT set_code FROM ingredient_sets)),
rej AS ({_first(
    "SELECT request_id, 'unknown_set' AS rule, 'set does not exist' AS message FROM r "
    "WHERE set_code NOT IN (SELECT set_code FROM ingredient_sets)",
    _membership('k', 'skus', 'SELECT set_code, sku AS val FROM ingredient_set_items', 'SKUs not in set: ', ['set_code']),
    "SELECT request_id, 'weight_sum', 'Weight percentages must sum to 100.00 after rounding' FROM k "
    "WHERE list_sum(list_transform(items, lambda x: CAST(x.wt_percent AS DECIMAL(38,2)))) <> 100")}),
valid AS (SELECT *, set_code AS scope_txt,
                 sha256(array_to_string(list_transform(list_sort(list_transform(items, lambda x: {{'k': x.sku, 'v': x.wt_percent}})),
                        lambda x: x.k || '=' || CAST(CAST(x.v AS DECIMAL(38,2)) AS VARCHAR)), '|')) AS h
          FROM k WHERE request_id NOT IN (SELECT request_id FROM rej)),
{_dedupe('weight_code', 1, "SELECT set_code AS scope_txt, weight_hash AS h, min(weight_code) AS code FROM dry_weight_variants GROUP BY set_code, weight_hash")}
{_out({'set_code': 'scope_txt', 'weight_code': 'code', 'weight_hash': 'h'}, 'SELECT * FROM results',
      'SELECT * FROM rej UNION ALL SELECT * FROM exhausted')}""")

register("register_variants", f"""
WITH r AS (SELECT request_id, submitted_at, upper(trim(set_code)) AS set_code, upper(trim(weight_code)) AS weight_code,
                  list_transform(items, lambda x: {{'sku': trim(x.sku), 'ingredient_batch_code': trim(x.ingredient_batch_code)}})
                    AS items FROM req_variants),
k AS (SELECT *, list_transform(items, lambda x: x.sku) AS skus,
             list_transform(items, lambda x: concat_ws(':', x.sku, x.ingredient_batch_code)) AS pairs
      FROM r WHERE (set_code, weight_code) IN (SELECT (set_code, weight_code) FROM dry_weight_variants)),
rej AS ({_first(
    "SELECT request_id, 'unknown_weight_variant' AS rule, 'dry weight variant does not exist' AS message FROM r "
    "WHERE (set_code, weight_code) NOT IN (SELECT (set_code, weight_code) FROM dry_weight_variants)",
    "SELECT request_id, 'malformed_pair', 'sku and ingredient_batch_code are required' FROM k WHERE "
    "list_bool_or(list_transform(items, lambda x: coalesce(x.sku = '' OR x.ingredient_batch_code = '', TRUE)))",
    _membership('k', 'pairs', "SELECT concat_ws(':', sku, ingredient_batch_code) AS val FROM ingredient_batches",
                'Unknown batches: '),
    _membership('k', 'skus', 'SELECT set_code, weight_code, sku AS val FROM dry_weight_items',
                'SKUs not in dry weight variant: ', ['set_code', 'weight_code']))}),
valid AS (SELECT *, set_code || ' ' || weight_code AS scope_txt,
                 sha256(array_to_string(list_transform(list_sort(list_transform(items,
                   lambda x: {{'k': x.sku, 'v': x.ingredient_batch_code}})), lambda x: x.k || '=' || x.v), '|')) AS h
          FROM k WHERE request_id NOT IN (SELECT request_id FROM rej)),
{_dedupe('batch_variant_code', 1, "SELECT set_code || ' ' || weight_code AS scope_txt, batch_hash AS h, min(batch_variant_code) AS code FROM batch_variants GROUP BY set_code, weight_code, batch_hash")}
{_out({'set_code': "split_part(scope_txt, ' ', 1)", 'weight_code': "split_part(scope_txt, ' ', 2)",
       'batch_variant_code': 'code', 'batch_hash': 'h'}, 'SELECT * FROM results',
      'SELECT * FROM rej UNION ALL SELECT * FROM exhausted')}""")

_FMT = ", ".join(_lit(x) for x in _R.FORMAT_VALUES)
_Q1 = f"""
SELECT request_id, rule, message FROM (
  SELECT request_id, 'pack_size_unit' AS rule, 'pack_size_unit must be kg or L' AS message, 0 AS prec FROM q
    WHERE NOT coalesce(pack_size_unit IN ('kg', 'L'), FALSE)
  UNION ALL SELECT request_id, 'pack_size_value', 'pack_size_value must be between 1 and 1000', 1 FROM q
    WHERE NOT coalesce(pack_size_value BETWEEN 1 AND 1000, FALSE)
  UNION ALL SELECT request_id, 'format', 'format must be one of {", ".join(_R.FORMAT_VALUES)}', 2 FROM q
    WHERE NOT coalesce(format IN ({_FMT}), FALSE))
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY prec) = 1"""
_ITEM_EQ = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in
                        ["category_code", "trade_name_inci", "supplier", "spec_grade", "format", "pack_size_unit",
                         "pack_size_value"])
_PROD_EQ = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in
                        ["category_code", "trade_name_inci", "supplier", "spec_grade", "format", "pack_size_unit"])

register("register_ingredients", f"""
WITH q AS (SELECT * REPLACE (nullif(trim(spec_grade), '') AS spec_grade) FROM req_ingredients),
bad AS ({_Q1}),
ok AS (SELECT * FROM q WHERE request_id NOT IN (SELECT request_id FROM bad)),
ranked AS (SELECT a.*, row_number() OVER (PARTITION BY category_code, trade_name_inci, supplier, spec_grade, format,
                  pack_size_unit, pack_size_value ORDER BY submitted_at, request_id) AS rk FROM ok a),
dups AS (SELECT request_id, 'duplicate' AS rule, 'Ingredient already exists' AS message FROM ranked a
         WHERE rk > 1 OR EXISTS (SELECT 1 FROM ingredients b WHERE {_ITEM_EQ})),
fresh AS (SELECT a.*, (SELECT min(b.seq) FROM ingredients b WHERE {_PROD_EQ}) AS known_seq FROM ok a
          WHERE request_id NOT IN (SELECT request_id FROM dups)),
products AS (SELECT category_code, trade_name_inci, supplier, spec_grade, format, pack_size_unit,
                    min((submitted_at, request_id)) AS o FROM fresh WHERE known_seq IS NULL
             GROUP BY category_code, trade_name_inci, supplier, spec_grade, format, pack_size_unit),
numbered AS (SELECT p.*, coalesce((SELECT max(next_value) FROM code_counters
                                    WHERE counter_name = 'ingredient_seq' AND scope = 'global'), 1)
                         + row_number() OVER (ORDER BY o) - 1 AS new_seq FROM products p),
acc AS (SELECT a.request_id, 'created' AS outcome, coalesce(a.known_seq, b.new_seq) AS seq, a.category_code,
               a.pack_size_value FROM fresh a LEFT JOIN numbered b ON {_PROD_EQ})
{_out({'sku': "printf('%d_%04d_%d', category_code, seq, pack_size_value)", 'seq': 'seq'}, 'SELECT * FROM acc',
      'SELECT * FROM bad UNION ALL SELECT * FROM dups')}""")

_ORD = "submitted_at, request_id"
_ITEM_COLS = "category_code, trade_name_inci, supplier, spec_grade, format, pack_size_unit, pack_size_value"
_PROD_COLS = "category_code, trade_name_inci, supplier, spec_grade, format, pack_size_unit"
register("register_import", f"""
WITH q AS (SELECT * FROM req_imports),
bad AS ({_Q1}),
p AS (SELECT *, trim(sku) AS t, nullif(trim(spec_grade), '') AS sg FROM req_imports
      WHERE request_id NOT IN (SELECT request_id FROM bad)),
parsed AS (SELECT *,
  CASE WHEN strpos(t, '_') > 0 THEN CASE WHEN len(string_split(t, '_')) = 3 THEN TRY_CAST(string_split(t, '_')[1] AS BIGINT) END
       WHEN length(t) >= 6 THEN TRY_CAST(substr(t, 1, 1) AS BIGINT) END AS pc,
  CASE WHEN strpos(t, '_') > 0 THEN CASE WHEN len(string_split(t, '_')) = 3 THEN TRY_CAST(string_split(t, '_')[2] AS BIGINT) END
       WHEN length(t) >= 6 THEN TRY_CAST(substr(t, 2, 4) AS BIGINT) END AS ps,
  CASE WHEN strpos(t, '_') > 0 THEN CASE WHEN len(string_split(t, '_')) = 3 THEN TRY_CAST(string_split(t, '_')[3] AS BIGINT) END
       WHEN length(t) >= 6 THEN TRY_CAST(substr(t, 6) AS BIGINT) END AS pp,
  CASE WHEN strpos(t, '_') > 0 AND len(string_split(t, '_')) <> 3 THEN 'sku format should be <category>_<seq>_<pack_size>'
       WHEN strpos(t, '_') = 0 AND length(t) < 6 THEN 'sku too short' END AS perr FROM p),
unparsable AS (SELECT request_id, 'invalid_sku' AS rule, coalesce(perr, 'sku parts must be integers') AS message
               FROM parsed WHERE perr IS NOT NULL OR pc IS NULL OR ps IS NULL OR pp IS NULL),
ok AS (SELECT request_id, submitted_at, t AS sku, pc AS category_code, ps AS seq, pp AS pack_size_value, pack_size_unit,
             trade_name_inci, supplier, sg AS spec_grade, format FROM parsed
      WHERE request_id NOT IN (SELECT request_id FROM unparsable)),
surv AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY {_ITEM_COLS} ORDER BY {_ORD}) = 1),
dup AS (SELECT request_id, 'duplicate' AS rule, 'Ingredient already exists' AS message FROM ok
        WHERE request_id NOT IN (SELECT request_id FROM surv)
        UNION ALL SELECT request_id, 'duplicate', 'Ingredient already exists' FROM surv a
        WHERE EXISTS (SELECT 1 FROM ingredients b WHERE {_ITEM_EQ})),
fresh AS (SELECT * FROM surv a WHERE NOT EXISTS (SELECT 1 FROM ingredients b WHERE {_ITEM_EQ})),
j AS (SELECT a.*, (SELECT min(b.seq) FROM ingredients b WHERE {_PROD_EQ}) AS pseq,
             EXISTS (SELECT 1 FROM ingredients b WHERE b.category_code = a.category_code AND b.seq = a.seq) AS taken
      FROM fresh a),
mism AS (SELECT request_id, 'seq_mismatch' AS rule, 'SKU sequence must match existing product' AS message FROM j
         WHERE pseq IS NOT NULL AND pseq <> seq),
used AS (SELECT request_id, 'seq_taken' AS rule, 'SKU sequence already assigned' AS message FROM j
         WHERE pseq IS NULL AND taken),
known_ok AS (SELECT * FROM j WHERE pseq IS NOT NULL AND pseq = seq),
nw AS (SELECT *, first_value(seq) OVER (PARTITION BY {_PROD_COLS} ORDER BY {_ORD}) AS bseq FROM j
       WHERE pseq IS NULL AND NOT taken),
b_mism AS (SELECT request_id, 'seq_mismatch' AS rule, 'SKU sequence must match existing product' AS message FROM nw
           WHERE bseq <> seq),
nw2 AS (SELECT *, first_value({{'c': category_code, 't': trade_name_inci, 's': supplier, 'g': spec_grade, 'f': format,
                                 'u': pack_size_unit}}) OVER (PARTITION BY category_code, seq ORDER BY {_ORD}) AS own
        FROM nw WHERE bseq = seq),
b_used AS (SELECT request_id, 'seq_taken' AS rule, 'SKU sequence already assigned' AS message FROM nw2
           WHERE own IS DISTINCT FROM {{'c': category_code, 't': trade_name_inci, 's': supplier, 'g': spec_grade,
                                        'f': format, 'u': pack_size_unit}}),
rej AS ({_first('SELECT * FROM bad', 'SELECT * FROM unparsable', 'SELECT * FROM dup', 'SELECT * FROM mism',
                'SELECT * FROM used', 'SELECT * FROM b_mism', 'SELECT * FROM b_used')}),
acc AS (SELECT request_id, sku, seq FROM known_ok
        UNION ALL SELECT request_id, sku, seq FROM nw2
        WHERE own IS NOT DISTINCT FROM {{'c': category_code, 't': trade_name_inci, 's': supplier, 'g': spec_grade,
                                          'f': format, 'u': pack_size_unit}})
{_out({'sku': 'sku', 'seq': 'seq'}, "SELECT request_id, 'created' AS outcome, sku, seq FROM acc", 'SELECT * FROM rej')}""")

register("register_locations", f"""
WITH r AS (SELECT request_id, upper(trim(set_code)) AS s, upper(trim(weight_code)) AS w,
                  upper(trim(batch_variant_code)) AS v, upper(trim(partner_code)) AS p, trim(production_date) AS d
           FROM req_locations),
reg AS (SELECT partner_code FROM {REGISTRY} x),
j AS (SELECT r.*, CASE WHEN p NOT IN (SELECT partner_code FROM reg) THEN 'unknown_partner'
                       WHEN d IS NULL OR NOT regexp_full_match(d, '[0-9]{{6}}') THEN 'invalid_date'
                       WHEN (s, w, v) NOT IN (SELECT (set_code, weight_code, batch_variant_code) FROM batch_variants)
                         THEN 'unknown_formulation' END AS reason FROM r)
{_out({'location_id': "concat_ws(' ', s, w, v, p, d)"}, "SELECT *, 'created' AS outcome FROM j WHERE reason IS NULL",
      'SELECT request_id, reason AS rule, reason AS message FROM j WHERE reason IS NOT NULL')}""")

register("register_partners", f"""
WITH used AS (SELECT partner_code FROM {REGISTRY} x),
st AS (SELECT greatest(coalesce(max(next_value), {_R.PARTNER_CODE_START}), {_R.PARTNER_CODE_START}) AS start
       FROM code_counters WHERE counter_name = 'location_partner_code' AND scope = ''),
free AS (SELECT value, {_code('value')} AS partner_code FROM (SELECT range AS value FROM range(0, 676)) r, st
         WHERE value >= st.start),
slots AS (SELECT row_number() OVER (ORDER BY value) - 1 AS slot, partner_code FROM free
          WHERE partner_code NOT IN (SELECT partner_code FROM used)),
req AS (SELECT *, row_number() OVER (ORDER BY submitted_at, request_id) - 1 AS slot FROM req_partners),
j AS (SELECT req.request_id, s.partner_code FROM req LEFT JOIN slots s ON s.slot = req.slot)
{_out({'partner_code': 'partner_code'}, "SELECT *, 'created' AS outcome FROM j WHERE partner_code IS NOT NULL",
      "SELECT request_id, 'code_space_exhausted' AS rule, 'Unable to allocate a unique partner code' AS message "
      "FROM j WHERE partner_code IS NULL")}""")

_FM = ", ".join(_lit(x) for x in _R.FAILURE_MODES)
register("register_hows", f"""
WITH r AS (SELECT *, upper(trim(process_code_suffix)) AS sfx,
                  trim(concat_ws(' ', location_code, upper(trim(process_code_suffix)))) AS code FROM req_hows),
bad AS (SELECT request_id, reason AS rule, reason AS message FROM (
          SELECT request_id, CASE WHEN NOT coalesce(regexp_full_match(sfx, '[A-Z]{{2}}'), FALSE) THEN 'invalid_suffix'
                                  WHEN NOT coalesce(failure_mode IN ({_FM}), FALSE) THEN 'invalid_failure_mode' END AS reason
          FROM r) WHERE reason IS NOT NULL),
ok AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY submitted_at, request_id) AS rk FROM r
       WHERE request_id NOT IN (SELECT request_id FROM bad)),
rej AS ({_first('SELECT * FROM bad',
                "SELECT request_id, 'duplicate' AS rule, 'Processing code already exists' AS message FROM ok "
                "WHERE code IN (SELECT processing_code FROM compounding_how WHERE is_active)",
                "SELECT request_id, 'duplicate', 'Processing code already exists' FROM ok WHERE rk > 1")})
{_out({'processing_code': 'code'},
      "SELECT request_id, 'created' AS outcome, code FROM ok WHERE request_id NOT IN (SELECT request_id FROM rej)",
      'SELECT * FROM rej')}""")

_PT = ", ".join(_lit(x) for x in _R.PRODUCT_TYPES)


def _opt(c: str) -> str:
    return f"CASE WHEN trim({c}) = 'Recieved' THEN 'Received' ELSE nullif(trim({c}), '') END"


def _vals(values: list[str]) -> str:
    return ", ".join(_lit(x) for x in values)


_BAGS_CTES = f"""
r AS (SELECT * REPLACE ({_opt('qc_status')} AS qc_status, {_opt('density_status')} AS density_status, {_opt('purpose')} AS purpose),
             trim(regexp_replace(compounding_how_code, '\\s+', ' ', 'g')) AS how, upper(trim(product_type)) AS pt
      FROM req_bags),
j AS (SELECT r.*, CASE WHEN NOT coalesce(pt IN ({_PT}), FALSE) THEN 'invalid_product_type'
                       WHEN NOT coalesce(number_of_bags BETWEEN 1 AND {_R.MAX_BAGS_PER_REQUEST}, FALSE) THEN 'invalid_number_of_bags'
                       WHEN NOT coalesce(bag_mass_kg >= 0, FALSE) THEN 'invalid_bag_mass'
                       WHEN remaining_mass_kg < 0 THEN 'invalid_remaining_mass'
                       WHEN how NOT IN (SELECT processing_code FROM compounding_how WHERE is_active)
                         THEN 'unknown_or_inactive_how'
                       WHEN qc_status NOT IN ({_vals(_R.STATUS_VOCAB['qc_status'])}) THEN 'invalid_qc_status'
                       WHEN density_status NOT IN ({_vals(_R.STATUS_VOCAB['density_status'])}) THEN 'invalid_density_status'
                       WHEN purpose NOT IN ({_vals(_R.PURPOSE_OPTIONS)}) THEN 'invalid_purpose' END AS reason FROM r),
ok AS (SELECT *, coalesce((SELECT max(next_value) FROM code_counters WHERE counter_name = 'pellet_bag_sequence'
                            AND scope = 'pellet_bag:global'), 0)
                 + coalesce(sum(number_of_bags) OVER (ORDER BY submitted_at, request_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_value
       FROM j WHERE reason IS NULL),
bags AS (SELECT *, first_value + unnest(range(number_of_bags)) AS value FROM ok)"""
register("register_bags", f"""
WITH {_BAGS_CTES}
{_out({'pellet_bag_code': "concat_ws(' ', how, pt, printf('%04d', value))", 'sequence_number': 'value'},
      "SELECT *, 'created' AS outcome FROM bags",
      'SELECT request_id, reason AS rule, reason AS message FROM j WHERE reason IS NOT NULL')}""")

_CTX_CTES = """
r AS (SELECT *, trim(regexp_replace(pellet_bag_code, '\\s+', ' ', 'g')) AS bag, trim(partner_code) AS pc, trim(machine_code) AS mc,
             trim(date_yymmdd) AS d,
             trim(regexp_replace(concat_ws(' ', pellet_bag_code, upper(trim(partner_code)), trim(date_yymmdd)),
                                 '\\s+', ' ', 'g')) AS code FROM req_contexts),
e AS (SELECT *, CASE WHEN bag NOT IN (SELECT trim(pellet_bag_code) FROM pellet_bags WHERE is_active) THEN 'unknown_bag'
                     WHEN NOT EXISTS (SELECT 1 FROM location_partners o WHERE trim(o.partner_code) = pc
                                      AND trim(o.machine_specification) = mc AND pc <> '' AND mc <> '') THEN 'unknown_partner_option'
                     WHEN NOT coalesce(regexp_full_match(d, '[0-9]{6}') AND try_strptime('20' || d, '%Y%m%d') IS NOT NULL, FALSE)
                       THEN 'invalid_date' END AS reason FROM r),
bad AS (SELECT request_id, reason AS rule, reason AS message FROM e WHERE reason IS NOT NULL),
ok AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY submitted_at, request_id) AS rk FROM e WHERE reason IS NULL),
acc AS (SELECT *, CASE WHEN code IN (SELECT context_code FROM conversion1_context WHERE is_active) THEN 'existing'
                       WHEN rk = 1 THEN 'created' ELSE 'duplicate' END AS outcome FROM ok)"""
register("register_contexts", f"""
WITH {_CTX_CTES}
{_out({'context_code': 'code'}, 'SELECT * FROM acc', 'SELECT * FROM bad')}""")

register("register_conversion_hows", f"""
WITH r AS (SELECT request_id, submitted_at, trim(regexp_replace(context_code, '\\s+', ' ', 'g')) AS ctx,
                  upper(trim(process_code)) AS pc, upper(trim(processing_code)) AS pgc,
                  lower(trim(coalesce(submit_action, 'generate'))) AS act, nullif(trim(failure_mode), '') AS fm,
                  machine_setup_url, processed_data_url FROM req_conversion_hows),
c AS (SELECT *, coalesce(nullif(trim(pgc), ''), nullif(trim(pc), ''), '') AS resolved FROM r),
e AS (SELECT *, CASE WHEN coalesce(ctx, '') = '' THEN 'Context code is required'
                     WHEN pc <> '' AND NOT regexp_full_match(pc, '[A-Z]{{2}}') THEN 'Process code must be a two-letter code'
                     WHEN pgc <> '' AND NOT regexp_full_match(pgc, '[A-Z]{{2}}') THEN 'Processing code must be a two-letter code'
                     WHEN act = 'save' AND resolved = ''
                       THEN 'Either Use Existing Process Code or Generate New Process Code is required.'
                     WHEN fm IS NOT NULL AND NOT coalesce(fm IN ({_FM}), FALSE)
                       THEN 'Failure mode must be selected from the allowed list' END AS reason FROM c),
nxt AS (SELECT context_code, greatest(coalesce(max({_ci.format('processing_code')}), 0), 0) + 1 AS base
        FROM conversion1_how WHERE is_active AND processing_code IS NOT NULL GROUP BY context_code),
gen AS (SELECT e.request_id, e.ctx || ' ' || {_code_or_null("coalesce(n.base, 1) + row_number() OVER (PARTITION BY e.ctx ORDER BY e.submitted_at, e.request_id) - 1")} AS code
        FROM e LEFT JOIN nxt n ON n.context_code = e.ctx WHERE e.reason IS NULL AND e.act = 'generate'),
sv AS (SELECT e.*, row_number() OVER (PARTITION BY ctx, resolved ORDER BY submitted_at, request_id) AS rk,
              EXISTS (SELECT 1 FROM conversion1_how h WHERE h.is_active AND h.context_code = e.ctx
                      AND h.processing_code = e.resolved) AS taken
       FROM e WHERE reason IS NULL AND act = 'save'),
acc AS (SELECT request_id, 'generated' AS outcome, code FROM gen WHERE code IS NOT NULL
        UNION ALL SELECT request_id, 'created', concat_ws(' ', ctx, resolved) FROM sv WHERE NOT taken AND rk = 1),
rej AS (SELECT request_id, 'invalid_request' AS rule, reason AS message FROM e WHERE reason IS NOT NULL
        UNION ALL SELECT request_id, 'duplicate', 'Processing code already exists for this context code' FROM sv
        WHERE taken OR rk > 1
        UNION ALL SELECT request_id, 'code_space_exhausted', 'no two-letter code left in this scope' FROM gen
        WHERE code IS NULL)
{_out({'conversion1_how_code': 'code'}, 'SELECT * FROM acc', 'SELECT * FROM rej')}""")

_PROD_CTES = f"""
r AS (SELECT * REPLACE ({_opt('storage_location')} AS storage_location, {_opt('tensile_rigid_status')} AS tensile_rigid_status,
                        {_opt('tensile_films_status')} AS tensile_films_status, {_opt('solubility_status')} AS solubility_status),
             trim(regexp_replace(conversion1_how_code, '\\s+', ' ', 'g')) AS how FROM req_products),
e AS (SELECT *, CASE WHEN NOT coalesce(number_of_records BETWEEN 1 AND {_R.MAX_PRODUCTS_PER_REQUEST}, FALSE) THEN 'invalid_number_of_records'
                     WHEN how NOT IN (SELECT conversion1_how_code FROM conversion1_how WHERE is_active) THEN 'unknown_or_inactive_how'
                     WHEN storage_location NOT IN ({_vals(_R.STORAGE_LOCATION_OPTIONS)}) THEN 'invalid_storage_location'
                     WHEN tensile_rigid_status NOT IN ({_vals(_R.TENSILE_STATUS_OPTIONS)}) THEN 'invalid_tensile_rigid_status'
                     WHEN tensile_films_status NOT IN ({_vals(_R.TENSILE_STATUS_OPTIONS)}) THEN 'invalid_tensile_films_status'
                     WHEN solubility_status NOT IN ({_vals(_R.OTHER_STATUS_OPTIONS)}) THEN 'invalid_solubility_status' END AS reason FROM r),
bad AS (SELECT request_id, reason AS rule, reason AS message FROM e WHERE reason IS NOT NULL),
ok AS (SELECT *, coalesce((SELECT max(next_suffix) FROM conversion1_product_counter WHERE id = 'global'), 0)
                 + coalesce(sum(number_of_records) OVER (ORDER BY submitted_at, request_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_value
       FROM e WHERE reason IS NULL),
n AS (SELECT *, first_value + unnest(range(number_of_records)) AS value FROM ok),
p AS (SELECT *, trim(concat_ws(' ', how, printf('%04d', value))) AS product_code FROM n)"""
register("register_products", f"""
WITH {_PROD_CTES}
{_out({'product_code': 'product_code'},
      "SELECT request_id, 'created' AS outcome, product_code FROM p "
      "WHERE product_code NOT IN (SELECT product_code FROM conversion1_products)", 'SELECT * FROM bad')}""")

register("scoped_codes", f"""
SELECT request_id, set_code, weight_code, value, {_code_or_null('value')} AS code FROM (
  SELECT r.request_id, r.set_code, r.weight_code,
         coalesce(c.next_value, 1) + row_number() OVER (PARTITION BY r.set_code, r.weight_code
                                                        ORDER BY r.submitted_at, r.request_id) - 1 AS value
  FROM req_locations r LEFT JOIN (SELECT scope, next_value FROM code_counters WHERE counter_name = 'batch_variant_code') c
    ON c.scope = concat_ws(' ', r.set_code, r.weight_code))""")

register("global_bag_numbers", """
SELECT request_id, unnest(range(number_of_bags)) AS "offset",
       first_value + unnest(range(number_of_bags)) AS value FROM (
  SELECT *, coalesce((SELECT max(next_value) FROM code_counters WHERE counter_name = 'pellet_bag_sequence'
                      AND scope = 'pellet_bag:global'), 0)
            + coalesce(sum(number_of_bags) OVER (ORDER BY submitted_at, request_id
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_value FROM req_bags)""")


# ---- single functions over whole tables ---------------------------------------------------------
register("used_ingredients", "SELECT sku, category_code, seq FROM ingredients WHERE sku IN (SELECT sku FROM batch_variant_items)")
register("batch_lookup", """
SELECT sku, ingredient_batch_code, quantity_value, archived FROM ingredient_batches b
WHERE EXISTS (SELECT 1 FROM (SELECT unnest(items) AS i FROM req_variants) r
              WHERE r.i.sku = b.sku AND r.i.ingredient_batch_code = b.ingredient_batch_code)""")
register("clamped_page", """
SELECT location_id, partner_code, created_at FROM location_codes
ORDER BY created_at DESC NULLS LAST, location_id DESC NULLS LAST LIMIT 200""")
register("json_rows", """
SELECT sku, '{"sku":"' || sku || '","seq":' || CAST(seq AS VARCHAR) || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S')
            || '","is_active":' || CAST(is_active AS VARCHAR) || '}' AS row_json FROM ingredients""")
register("parsed_timestamps", """
SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) - CASE WHEN o_orderkey % 3 = 2 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS at FROM orders""")
register("exact_weights", """
SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity * 12.5 + 0.5) / 100 AS DECIMAL(38, 2)) AS rounded FROM lineitem""")
register("folded_names", "SELECT sku, lower(trade_name_inci) AS folded FROM ingredients")

# ---- rows that registration writes ------------------------------------------------------------
register("written_bags", f"""
WITH {_BAGS_CTES}
SELECT concat_ws(' ', how, pt, printf('%04d', value)) AS pellet_bag_code,
       substr(sha256(concat_ws(' ', how, pt, printf('%04d', value))), 1, 32) AS pellet_bag_id, how AS compounding_how_code,
       pt AS product_type, value AS sequence_number, bag_mass_kg, coalesce(remaining_mass_kg, bag_mass_kg) AS remaining_mass_kg,
       short_moisture_percent, purpose, CAST(NULL AS VARCHAR) AS reference_sample_taken, qc_status, density_status,
       CAST(NULL AS VARCHAR) AS long_moisture_status, trim(density_assignee_email) AS density_assignee_email,
       nullif(trim(notes), '') AS notes, customer, actor AS created_by
FROM bags""")
register("written_contexts", f"""
WITH {_CTX_CTES}
SELECT code AS context_code, bag AS pellet_bag_code, upper(pc) AS partner_code, mc AS machine_code, d AS date_yymmdd,
       actor AS created_by, TRUE AS is_active FROM acc WHERE outcome = 'created'""")
register("written_products", f"""
WITH {_PROD_CTES}
SELECT product_code, how AS conversion1_how_code, printf('%04d', value) AS product_suffix, storage_location,
       nullif(trim(notes), '') AS notes, numbered_in_order, coalesce(tensile_rigid_status, 'Not Requested') AS tensile_rigid_status,
       coalesce(tensile_films_status, tensile_rigid_status, 'Not Requested') AS tensile_films_status,
       coalesce(solubility_status, 'Not Requested') AS solubility_status, 'Not Requested' AS friction_status, width_mm,
       sd_film_thickness, actor AS created_by
FROM p WHERE product_code NOT IN (SELECT product_code FROM conversion1_products)""")
register("written_sets", """
WITH o AS (SELECT request_id, outcome, set_code, set_hash FROM (""" + SQL_BODY["register_sets"] + """) WHERE outcome <> 'rejected'),
c AS (SELECT o.set_code, o.set_hash, r.* FROM o JOIN req_sets r ON CAST(r.request_id AS VARCHAR) = o.request_id
      WHERE o.outcome = 'created'),
m AS (SELECT o.set_code, nullif(trim(r.notes), '') AS notes, r.actor FROM o JOIN req_sets r ON CAST(r.request_id AS VARCHAR) = o.request_id
      WHERE o.outcome <> 'created' AND nullif(trim(r.notes), '') IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY o.set_code ORDER BY r.submitted_at DESC, r.request_id DESC) = 1)
SELECT 'header' AS part, set_code, set_hash AS value, nullif(trim(notes), '') AS notes, actor FROM c
UNION ALL SELECT 'item', set_code, unnest(skus), NULL, actor FROM c
UNION ALL SELECT 'meta', set_code, NULL, notes, actor FROM m
UNION ALL SELECT 'counter', scope, CAST(greatest(next_value, coalesce((SELECT max(""" + _ci.format("set_code") + """) + 1 FROM c), 0)) AS VARCHAR),
                 NULL, NULL FROM code_counters WHERE counter_name = 'set_code'""")


# ---- table changes ---------------------------------------------------------------------------
AS_OF_SQL = "TIMESTAMP '2025-01-01 00:00:00'"
_ROLE_MAP = "CASE lower(trim(role_group)) " + " ".join(
    f"WHEN {_lit(r)} THEN {_lit(','.join(sorted(set(p))))}" for r, p in _R.ROLE_GROUPS.items()) + " ELSE '' END"
_ROLES_J = f"""
ch AS (SELECT lower(trim(email)) AS k, nullif(trim(first_name), '') AS first_name, nullif(trim(last_name), '') AS last_name,
              lower(trim(role_group)) AS role_group, {_ROLE_MAP} AS permissions, is_active, actor FROM chg_roles
       WHERE trim(email) <> '' AND lower(trim(role_group)) IN ({", ".join(_lit(r) for r in _R.ROLE_GROUPS)})
       QUALIFY row_number() OVER (PARTITION BY lower(trim(email)) ORDER BY ts DESC, event_id DESC) = 1),
j AS (SELECT t.email AS temail, t.first_name AS tf, t.last_name AS tl, t.role_group AS tr, t.is_active AS ta,
             array_to_string(t.permissions, ',') AS tp, ch.permissions,
             t.created_at AS tca, t.created_by AS tcb, t.updated_at AS tua, t.updated_by AS tub,
             ch.k, ch.first_name, ch.last_name, ch.role_group, ch.is_active, ch.actor,
             ch.k IS NOT NULL AS hit
      FROM (SELECT *, lower(email) AS k0 FROM user_roles) t FULL OUTER JOIN ch ON ch.k = t.k0),
o AS (SELECT *, temail IS NOT NULL AND hit AS upd, temail IS NULL AS new FROM j)"""
register("upsert_roles", f"""
WITH {_ROLES_J}
SELECT coalesce(temail, k) AS email,
       CASE WHEN upd OR new THEN first_name ELSE tf END AS first_name,
       CASE WHEN upd OR new THEN last_name ELSE tl END AS last_name,
       CASE WHEN upd OR new THEN role_group ELSE tr END AS role_group,
       CASE WHEN upd OR new THEN permissions ELSE tp END AS permissions,
       CASE WHEN upd OR new THEN is_active ELSE ta END AS is_active,
       CASE WHEN new THEN {AS_OF_SQL} ELSE tca END AS created_at,
       CASE WHEN new THEN actor ELSE tcb END AS created_by,
       CASE WHEN upd OR new THEN {AS_OF_SQL} ELSE tua END AS updated_at,
       CASE WHEN upd OR new THEN actor ELSE tub END AS updated_by
FROM o""")
register("upsert_roles_counts", f"""
WITH {_ROLES_J}
SELECT CAST(sum(CASE WHEN upd THEN 1 ELSE 0 END) AS BIGINT) AS updated,
       CAST(sum(CASE WHEN new THEN 1 ELSE 0 END) AS BIGINT) AS inserted FROM o""")
register("counter_floor", f"""
WITH f AS (SELECT counter_name, scope, max(next_value) AS fl FROM chg_floors GROUP BY counter_name, scope),
j AS (SELECT coalesce(c.counter_name, f.counter_name) AS counter_name, coalesce(c.scope, f.scope) AS scope,
             c.next_value, c.updated_at, f.fl,
             f.fl IS NOT NULL AND (c.next_value IS NULL OR f.fl > c.next_value) AS raised
      FROM code_counters c FULL OUTER JOIN f ON f.counter_name = c.counter_name AND f.scope = c.scope)
SELECT counter_name, scope, CASE WHEN raised THEN fl ELSE next_value END AS next_value,
       CASE WHEN raised THEN {AS_OF_SQL} ELSE updated_at END AS updated_at FROM j""")
register("seed_counters", f"""
WITH s AS (SELECT * FROM (VALUES ('set_code', '', 1), ('location_partner_code', '', {_R.PARTNER_CODE_START}),
                                 ('ingredient_seq', 'global', 1), ('pellet_bag_sequence', 'pellet_bag:global', 0))
           AS v(counter_name, scope, next_value))
SELECT counter_name, scope, next_value, updated_at FROM code_counters
UNION ALL SELECT counter_name, scope, next_value, {AS_OF_SQL} FROM s
WHERE NOT EXISTS (SELECT 1 FROM code_counters c WHERE c.counter_name = s.counter_name AND c.scope = s.scope)""")
_BAG_PRESENT = ["remaining_mass_kg", "qc_status", "notes", "customer"]
_BAG_COLS = [
    "remaining_mass_kg", "short_moisture_percent", "purpose", "reference_sample_taken", "qc_status",
    "long_moisture_status", "density_status", "injection_moulding_status", "film_forming_status",
    "long_moisture_assignee_email", "density_assignee_email", "injection_moulding_assignee_email",
    "film_forming_assignee_email", "notes", "customer"]
register("patch_bags", f"""
WITH c AS (SELECT pellet_bag_id, arg_max(actor, submitted_at) AS actor,
                  {", ".join(f"arg_max({x}, submitted_at) FILTER ({x} IS NOT NULL) AS {x}" for x in _BAG_PRESENT)}
           FROM chg_bags WHERE NOT coalesce(remaining_mass_kg < 0, FALSE) GROUP BY pellet_bag_id)
SELECT b.pellet_bag_id, b.pellet_bag_code,
       {", ".join(f"CASE WHEN c.pellet_bag_id IS NOT NULL THEN coalesce(c.{x}, b.{x}) ELSE b.{x} END AS {x}" if x in _BAG_PRESENT
                  else f"b.{x}" for x in _BAG_COLS)},
       CASE WHEN c.pellet_bag_id IS NOT NULL THEN {AS_OF_SQL} ELSE b.updated_at END AS updated_at,
       CASE WHEN c.pellet_bag_id IS NOT NULL THEN c.actor ELSE b.updated_by END AS updated_by
FROM pellet_bags b LEFT JOIN c ON c.pellet_bag_id = b.pellet_bag_id AND b.is_active""")
_PRODUCT_PRESENT = ["storage_location", "notes", "tensile_rigid_status"]
_PRODUCT_COLS = [
    "storage_location", "notes", "number_units_produced", "numbered_in_order", "tensile_rigid_status",
    "tensile_films_status", "seal_strength_status", "shelf_stability_status", "solubility_status",
    "defect_analysis_status", "blocking_status", "film_emc_status", "friction_status", "width_mm", "length_m",
    "avg_film_thickness_um", "sd_film_thickness", "film_thickness_variation_percent"]
register("patch_products", f"""
SELECT p.product_code,
       {", ".join(f"CASE WHEN c.product_code IS NOT NULL THEN c.{x} ELSE p.{x} END AS {x}" if x in _PRODUCT_PRESENT
                  else f"p.{x}" for x in _PRODUCT_COLS)},
       CASE WHEN c.product_code IS NOT NULL THEN {AS_OF_SQL} ELSE p.updated_at END AS updated_at,
       CASE WHEN c.product_code IS NOT NULL THEN c.actor ELSE p.updated_by END AS updated_by
FROM conversion1_products p LEFT JOIN chg_products c ON c.product_code = p.product_code AND p.is_active""")
register("archive_batches", f"""
SELECT b.sku, b.ingredient_batch_code,
       CASE WHEN c.sku IS NOT NULL THEN c.archived ELSE b.archived END AS archived,
       CASE WHEN c.sku IS NOT NULL THEN CASE WHEN c.archived THEN {AS_OF_SQL} END ELSE b.archived_at END AS archived_at,
       CASE WHEN c.sku IS NOT NULL THEN CASE WHEN c.archived THEN c.actor END ELSE b.archived_by END AS archived_by,
       CASE WHEN c.sku IS NOT NULL THEN {AS_OF_SQL} ELSE b.updated_at END AS updated_at,
       CASE WHEN c.sku IS NOT NULL THEN c.actor ELSE b.updated_by END AS updated_by
FROM ingredient_batches b LEFT JOIN chg_archive c
  ON c.sku = b.sku AND c.ingredient_batch_code = b.ingredient_batch_code""")

_EDIT = _R.EDITABLE_STATUS_COLUMNS
_VOCAB = "CASE status_column " + " ".join(
    f"WHEN '{c}' THEN [{', '.join(_lit(v) for v in _R.STATUS_VOCAB[c])}]" for c in _EDIT) + " END"
_STATUS_R = f"""
ch AS (SELECT c.*, CASE WHEN nullif(trim(status_value), '') = 'Recieved' THEN 'Received'
                        ELSE nullif(trim(status_value), '') END AS v,
              nullif(trim(assigned_value), '') AS a FROM chg_status c),
j AS (SELECT ch.*, (SELECT count(*) FROM pellet_bags b WHERE b.is_active AND b.pellet_bag_code = ch.pellet_bag_code) AS n,
             a IN (SELECT email FROM pellet_bag_assignees WHERE is_active) AS a_ok FROM ch),
r AS (SELECT j.*, CASE WHEN status_column NOT IN ({', '.join(_lit(c) for c in _EDIT)}) THEN 'invalid_status_column'
                       WHEN v IS NULL OR NOT list_contains({_VOCAB}, v) THEN 'invalid_status_value'
                       WHEN a IS NOT NULL AND NOT coalesce(a_ok, FALSE) THEN 'invalid_assignee'
                       WHEN n <> 1 THEN 'not_exactly_one_row' END AS reason FROM j)"""
register("status_update_rejects", f"""
WITH {_STATUS_R}
SELECT pellet_bag_code, status_column, status_value, assigned_value, reason FROM r WHERE reason IS NOT NULL""")
_piv = ", ".join(f"bool_or(status_column = '{c}') AS h_{i}, max(CASE WHEN status_column = '{c}' THEN v END) AS v_{i}, "
                 f"max(CASE WHEN status_column = '{c}' THEN a END) AS a_{i}" for i, c in enumerate(_EDIT))
_sets = ", ".join(f"CASE WHEN hit AND h_{i} THEN v_{i} ELSE b.{c} END AS {c}" for i, c in enumerate(_EDIT))
_asg = ", ".join(f"CASE WHEN hit AND h_{i} THEN a_{i} ELSE b.{_R.STATUS_ASSIGNEE[c]} END AS {_R.STATUS_ASSIGNEE[c]}"
                 for i, c in enumerate(_EDIT))
register("status_update", f"""
WITH {_STATUS_R},
ok AS (SELECT * FROM r WHERE reason IS NULL
       QUALIFY row_number() OVER (PARTITION BY pellet_bag_code, status_column ORDER BY submitted_at DESC) = 1),
piv AS (SELECT pellet_bag_code AS pcode, max(actor) AS actor, {_piv} FROM ok GROUP BY pellet_bag_code),
jj AS (SELECT b.*, p.*, p.pcode IS NOT NULL AND b.is_active AS hit FROM pellet_bags b
       LEFT JOIN piv p ON p.pcode = b.pellet_bag_code)
SELECT b.pellet_bag_code, {_sets}, {_asg},
       CASE WHEN hit THEN {AS_OF_SQL} ELSE b.updated_at END AS updated_at,
       CASE WHEN hit THEN b.actor ELSE b.updated_by END AS updated_by
FROM jj b""")
register("update_hows", f"""
SELECT h.processing_code,
       CASE WHEN c.processing_code IS NOT NULL THEN c.failure_mode ELSE h.failure_mode END AS failure_mode,
       CASE WHEN c.processing_code IS NOT NULL THEN nullif(trim(c.machine_setup_url), '') ELSE h.machine_setup_url END
         AS machine_setup_url,
       CASE WHEN c.processing_code IS NOT NULL THEN nullif(trim(c.processed_data_url), '') ELSE h.processed_data_url END
         AS processed_data_url,
       CASE WHEN c.processing_code IS NOT NULL THEN nullif(trim(c.notes), '') ELSE h.notes END AS notes,
       CASE WHEN c.processing_code IS NOT NULL THEN {AS_OF_SQL} ELSE h.updated_at END AS updated_at,
       CASE WHEN c.processing_code IS NOT NULL THEN c.actor ELSE h.updated_by END AS updated_by
FROM compounding_how h LEFT JOIN (SELECT * FROM chg_hows QUALIFY row_number() OVER (PARTITION BY processing_code
                             ORDER BY submitted_at DESC) = 1) c ON c.processing_code = h.processing_code AND h.is_active""")
register("set_meta", """
SELECT s.set_code, CASE WHEN c.set_code IS NOT NULL THEN c.notes ELSE s.notes END AS notes,
       CASE WHEN c.set_code IS NOT NULL THEN c.material_workstream ELSE s.material_workstream END AS material_workstream,
       CASE WHEN c.set_code IS NOT NULL THEN coalesce(s.created_by, f.actor) ELSE s.created_by END AS created_by
FROM ingredient_sets s LEFT JOIN (SELECT * FROM chg_set_meta QUALIFY row_number() OVER (PARTITION BY set_code
                                  ORDER BY submitted_at DESC) = 1) c ON c.set_code = s.set_code
LEFT JOIN (SELECT set_code, arg_min(actor, submitted_at) AS actor FROM chg_set_meta GROUP BY set_code) f ON f.set_code = s.set_code""")
_DOCS_BAD = """
SELECT sku, filename, rule, message FROM (
  SELECT m.*, i.msds_object_path IS NOT NULL AS has,
         coalesce(content_type, '') = 'application/pdf' AS is_pdf, i.sku IS NULL AS unknown
  FROM doc_manifest m LEFT JOIN ingredients i ON i.sku = m.sku) x,
LATERAL (SELECT * FROM (VALUES
   (unknown, 'unknown_target', 'Target not found'),
   (NOT is_pdf, 'not_pdf', 'Only PDF files are allowed'),
   (coalesce(size_bytes, 0) <= 0, 'empty_file', 'File is empty'),
   (coalesce(size_bytes, 0) > 20971520, 'too_large', 'File too large'),
   (coalesce(has, FALSE) AND NOT coalesce(confirm_replace, FALSE), 'replace_not_confirmed',
    'Replacing an existing document must be confirmed')) AS v(failed, rule, message) WHERE failed)"""
register("quality_documents", _DOCS_BAD)
register("set_document", f"""
WITH bad AS ({_DOCS_BAD}),
ok AS (SELECT * FROM doc_manifest m WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.sku = m.sku AND bad.filename = m.filename)
       QUALIFY row_number() OVER (PARTITION BY sku ORDER BY uploaded_at DESC, object_path DESC) = 1)
SELECT i.sku,
       CASE WHEN o.sku IS NOT NULL THEN o.object_path ELSE i.msds_object_path END AS msds_object_path,
       CASE WHEN o.sku IS NOT NULL THEN o.filename ELSE i.msds_filename END AS msds_filename,
       CASE WHEN o.sku IS NOT NULL THEN o.content_type ELSE i.msds_content_type END AS msds_content_type,
       CASE WHEN o.sku IS NOT NULL THEN o.uploaded_at ELSE i.msds_uploaded_at END AS msds_uploaded_at,
       CASE WHEN o.sku IS NOT NULL THEN {AS_OF_SQL} ELSE i.updated_at END AS updated_at,
       CASE WHEN o.sku IS NOT NULL THEN o.actor ELSE i.updated_by END AS updated_by
FROM ingredients i LEFT JOIN ok o ON o.sku = i.sku""")
_DEPS = """SELECT set_code, count(*) AS n, 'dry_weight_variants' AS source FROM dry_weight_variants GROUP BY set_code
UNION ALL SELECT set_code, count(*), 'batch_variants' FROM batch_variants GROUP BY set_code
UNION ALL SELECT set_code, count(*), 'location_codes' FROM location_codes GROUP BY set_code"""
register("role_rejects", f"""
SELECT event_id, email, role_group, CASE WHEN coalesce(trim(email), '') = '' THEN 'email_required' ELSE 'invalid_role_group' END AS reason
FROM chg_roles WHERE coalesce(trim(email), '') = ''
                  OR NOT coalesce(lower(trim(role_group)) IN ({", ".join(_lit(r) for r in _R.ROLE_GROUPS)}), FALSE)""")
register("patch_bag_rejects", """
SELECT pellet_bag_id, 'bounds_remaining_mass_kg' AS rule, 'remaining_mass_kg must be >= 0' AS message FROM chg_bags
WHERE remaining_mass_kg < 0""")
register("set_spec_document", f"""
WITH u AS (SELECT sku, ingredient_batch_code, 'specs/' || sku || '/' || ingredient_batch_code || '.pdf' AS object_path,
                  received_at + INTERVAL 3 DAY AS uploaded_at FROM ingredient_batches
           UNION ALL SELECT sku, ingredient_batch_code, 'specs/' || sku || '/first.pdf', received_at FROM ingredient_batches),
p AS (SELECT * FROM u WHERE uploaded_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sku, ingredient_batch_code ORDER BY uploaded_at DESC) = 1)
SELECT b.sku, b.ingredient_batch_code, coalesce(p.object_path, b.spec_object_path) AS spec_object_path,
       coalesce(p.uploaded_at, b.spec_uploaded_at) AS spec_uploaded_at,
       CASE WHEN p.sku IS NOT NULL THEN {AS_OF_SQL} ELSE b.updated_at END AS updated_at, b.updated_by
FROM ingredient_batches b LEFT JOIN p ON p.sku = b.sku AND p.ingredient_batch_code = b.ingredient_batch_code""")
register("cascade_delete", f"""
WITH made AS (SELECT set_code FROM ({SQL_BODY["register_sets"]}) WHERE outcome = 'created'),
all_sets AS (SELECT set_code FROM ingredient_sets UNION ALL SELECT set_code FROM made),
req AS (SELECT 'S' || CAST(o_orderkey AS VARCHAR) AS set_code FROM orders UNION ALL SELECT set_code FROM made),
deps AS ({_DEPS}),
blocked AS (SELECT set_code, string_agg(source || '=' || CAST(n AS VARCHAR), ', '
                                        ORDER BY source || '=' || CAST(n AS VARCHAR)) AS reason
            FROM deps WHERE n > 0 AND set_code IN (SELECT set_code FROM req) GROUP BY set_code),
allowed AS (SELECT set_code FROM req WHERE set_code NOT IN (SELECT set_code FROM blocked))
SELECT set_code, 'kept' AS outcome, CAST(NULL AS VARCHAR) AS reason FROM all_sets
WHERE set_code NOT IN (SELECT set_code FROM allowed)
UNION ALL SELECT set_code, 'blocked', reason FROM blocked""")
register("seed_assignees", f"""
SELECT email, is_active, created_at, created_by FROM pellet_bag_assignees
UNION ALL SELECT email, TRUE, {AS_OF_SQL}, CAST(NULL AS VARCHAR)
FROM (SELECT DISTINCT created_by AS email FROM pellet_bags WHERE created_by IS NOT NULL) d
WHERE NOT EXISTS (SELECT 1 FROM pellet_bag_assignees WHERE is_active)""")

# ---- quality -------------------------------------------------------------------------------------
register("quality_ingredients", f"""
SELECT sku, 'pack_size_unit' AS rule, 'pack_size_unit must be kg or L' AS message FROM ingredients
WHERE NOT coalesce(pack_size_unit IN ('kg', 'L'), FALSE)
UNION ALL SELECT sku, 'pack_size_value', 'pack_size_value must be between 1 and 1000' FROM ingredients
WHERE NOT coalesce(pack_size_value BETWEEN 1 AND 1000, FALSE)
UNION ALL SELECT sku, 'format', 'format must be one of {", ".join(_R.FORMAT_VALUES)}' FROM ingredients
WHERE NOT coalesce(format IN ({_FMT}), FALSE)""")
register("quality_weights", """
SELECT set_code, weight_code, CAST(sum(round(CAST(wt_percent AS DECIMAL(38,9)), 2)) AS DECIMAL(38,2)) AS total,
       'weight_sum' AS rule, 'Weight percentages must sum to 100.00 after rounding' AS message
FROM dry_weight_items GROUP BY set_code, weight_code
HAVING sum(round(CAST(wt_percent AS DECIMAL(38,9)), 2)) <> 100""")
_WT = ("list_reduce(list_transform(dry_weight_items, lambda x: coalesce(TRY_CAST(CAST(x.wt_percent AS VARCHAR) AS DOUBLE), "
       "0.0)), lambda a, b: a + b)")
register("quality_weight_close", f"""
SELECT set_code, weight_code, batch_variant_code, round({_WT}, 6) AS total, abs({_WT} - 100.0) <= 0.01 AS close
FROM v_flat""")
_ENUM_V = {**_R.STATUS_VOCAB, "purpose": _R.PURPOSE_OPTIONS, "reference_sample_taken": _R.REFERENCE_SAMPLE_OPTIONS}
register("quality_enums", " UNION ALL ".join(f"""
SELECT pellet_bag_id, '{c}' AS column, v AS value, 'enum' AS rule, 'Invalid {c}' AS message FROM (
  SELECT pellet_bag_id, CASE WHEN nullif(trim({c}), '') = 'Recieved' THEN 'Received' ELSE nullif(trim({c}), '') END AS v
  FROM pellet_bags) WHERE v IS NOT NULL AND v NOT IN ({', '.join(_lit(x) for x in vals)})""" for c, vals in _ENUM_V.items()))
register("quality_membership", f"""
WITH bv AS (SELECT set_code || ' ' || weight_code || ' ' || batch_variant_code AS request_id, set_code,
                   list_transform(items, lambda x: x.sku) AS skus FROM v_batches)
SELECT request_id AS base_code, rule, message FROM (
  {_membership('bv', 'skus', 'SELECT set_code, sku AS val FROM ingredient_set_items WHERE sku IN (SELECT sku FROM ingredients WHERE is_active)', 'SKUs outside set: ', ['set_code'])})""")
register("quality_bounds", """
SELECT pellet_bag_id, rule, message FROM pellet_bags,
LATERAL (SELECT * FROM (VALUES
  (coalesce(bag_mass_kg < 0, FALSE), 'bounds_bag_mass_kg', 'bag_mass_kg must be >= 0'),
  (coalesce(remaining_mass_kg < 0, FALSE), 'bounds_remaining_mass_kg', 'remaining_mass_kg must be >= 0'),
  (coalesce(short_moisture_percent < 0 OR short_moisture_percent > 100, FALSE), 'bounds_short_moisture_percent',
   'short_moisture_percent must be between 0 and 100')) AS v(failed, rule, message) WHERE failed)""")
register("quality_patch", """
SELECT pellet_bag_code, 'empty_patch' AS rule, 'No editable fields provided' AS message FROM chg_bags
WHERE coalesce(nullif(trim(CAST(remaining_mass_kg AS VARCHAR)), ''), nullif(trim(notes), ''),
               nullif(trim(customer), '')) IS NULL""")
register("quality_assignees", " UNION ALL ".join(f"""
SELECT pellet_bag_id, '{a}' AS column, nullif(trim({a}), '') AS value, 'assignee' AS rule,
       'Assignee must be an active assignee' AS message FROM pellet_bags
WHERE nullif(trim({a}), '') IS NOT NULL
  AND nullif(trim({a}), '') NOT IN (SELECT email FROM pellet_bag_assignees WHERE is_active)"""
                                                 for a in [_R.STATUS_ASSIGNEE[c] for c in _EDIT]))

# ---- access policy -----------------------------------------------------------------------------
_ROLE_ROWS = ", ".join(f"({_lit(r)}, {_lit(p)})" for r, perms in _R.ROLE_GROUPS.items() for p in sorted(set(perms)))
ROLE_TABLE = f"(SELECT * FROM (VALUES {_ROLE_ROWS}) AS rt(role_group, permission))"
register("role_permissions", f"""
SELECT lower(trim(u.email)) AS email, u.role_group, u.is_active, rt.permission
FROM user_roles u JOIN {ROLE_TABLE} rt ON rt.role_group = lower(trim(u.role_group))""")
_ACCESS = f"""
users AS (SELECT DISTINCT lower(trim(regexp_replace(email, '^[^:]*:', ''))) AS email FROM (
            SELECT created_by AS email FROM pellet_bags WHERE created_by IS NOT NULL
            UNION ALL SELECT CASE WHEN length(email) % 2 = 0 THEN 'idp.example.com:' || upper(email) ELSE email END
            FROM user_roles)),
act AS (SELECT lower(email) AS email, role_group FROM user_roles WHERE is_active),
boot AS (SELECT count(*) = 0 AS b FROM user_roles WHERE is_active),
perms AS (SELECT role_group, list(permission ORDER BY permission) AS p FROM {ROLE_TABLE} GROUP BY role_group),
held AS (SELECT u.email, CASE WHEN a.email IS NULL AND boot.b THEN 'admin' ELSE coalesce(a.role_group, '') END AS r,
                a.email IS NULL AND boot.b AS is_bootstrap_admin
         FROM users u LEFT JOIN act a ON a.email = u.email CROSS JOIN boot),
acc AS (SELECT h.email, CASE WHEN r = '' THEN 'unassigned' ELSE r END AS role_group, r = 'admin' AS is_admin,
               is_bootstrap_admin, coalesce(p.p, []::VARCHAR[]) AS permissions
        FROM held h LEFT JOIN perms p ON p.role_group = lower(trim(r)))"""
register("effective_access", f"""
WITH {_ACCESS}
SELECT email, role_group, is_admin, is_bootstrap_admin, len(permissions) AS n_permissions,
       list_contains(permissions, 'dry_weights.view') AS can_view_dry_weights FROM acc""")
register("combined_permissions", f"""
WITH {_ACCESS}
SELECT email, array_to_string(list_sort(list_distinct(list_concat(permissions, [{", ".join(_lit(p) for p in _R.MIXING_1_PERMISSIONS)}]))), ',')
         AS permissions_text FROM acc""")
register("masked_formulations", f"""
WITH {_ACCESS}
SELECT f.set_code, f.weight_code, f.batch_variant_code, f.base_code, f.created_at, f.created_by, f.sku_count,
       {skus('f.sku_list')} AS sku_list_text,
       {pairs('f.batch_items', 'sku', 'ingredient_batch_code')} AS batch_items_text,
       CASE WHEN coalesce(list_contains(a.permissions, 'dry_weights.view'), FALSE)
            THEN {pairs('f.dry_weight_items', 'sku', 'wt_percent')} END AS dry_weight_items_text
FROM v_flat f LEFT JOIN acc a ON a.email = f.created_by""")
register("sku_summary_masked", f"""
WITH {_ACCESS}
SELECT DISTINCT i.sku AS requested_sku, f.set_code, f.weight_code, f.batch_variant_code, f.base_code, f.created_at,
       f.created_by AS viewer
FROM ingredients i JOIN (SELECT f.*, unnest(f.sku_list) AS s FROM v_flat f) f ON f.s = i.sku
WHERE f.created_by IN (SELECT email FROM acc WHERE list_contains(permissions, 'batch_selection.view'))""")
register("stream_register_sets", "SELECT request_id, outcome <> 'rejected' AS accepted, set_code, rule FROM ("
         + SQL["register_sets"].replace("WITH ", "WITH ", 1) + ") x")


# ---- sources, schema checks, lookups, paging variants -------------------------------------------
register("archived_backfill", """
SELECT coalesce(archived, FALSE) AS archived, count(*) AS n FROM ingredient_batches GROUP BY coalesce(archived, FALSE)""")

_NULL_CHECKS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{f.name}' AS column_name, 'null_in_required_column' AS problem "
    f"WHERE EXISTS (SELECT 1 FROM {t} WHERE {f.name} IS NULL)"
    for t, schema in sorted(_SCHEMAS.items()) for f in schema.fields if not f.nullable)
register("schema_problems", _NULL_CHECKS)
register("formulation_codes_fallback", "SELECT DISTINCT set_code, weight_code, batch_variant_code FROM batch_variants")
register("active_role_count", "SELECT count(*) AS active_roles FROM user_roles WHERE is_active")
register("assignee_list", "SELECT email FROM pellet_bag_assignees WHERE is_active")
register("set_list", "SELECT set_code, array_to_string(sku_list, ',') AS sku_list_text, notes, material_workstream "
                     "FROM v_sets")
register("sets_page", """
SELECT set_code, created_at, array_to_string(sku_list, ',') AS sku_list_text FROM v_sets
WHERE contains(lower(set_code), '_00') OR list_bool_or(list_transform(sku_list, lambda x: contains(lower(x), '_00')))
ORDER BY created_at ASC NULLS FIRST, set_code ASC NULLS FIRST LIMIT 50 OFFSET 50""")
_K = "TIMESTAMP '1998-06-01 00:00:00'"
register("formulations_keyset", f"""
SELECT {FLAT_TEXT} FROM v_flat
WHERE created_at < {_K}
   OR (created_at = {_K} AND set_code < 'MM')
   OR (created_at = {_K} AND set_code = 'MM' AND weight_code < 'MM')
   OR (created_at = {_K} AND set_code = 'MM' AND weight_code = 'MM' AND batch_variant_code < 'MM')
ORDER BY {FORM_ORDER} LIMIT 50""")
register("existing_batches", """
SELECT DISTINCT p.sku, p.ingredient_batch_code FROM (
  SELECT nullif(trim(i.sku), '') AS sku, nullif(trim(i.ingredient_batch_code), '') AS ingredient_batch_code
  FROM (SELECT unnest(items) AS i FROM req_variants)) p
WHERE p.sku IS NOT NULL AND p.ingredient_batch_code IS NOT NULL
  AND EXISTS (SELECT 1 FROM ingredient_batches b WHERE b.sku = p.sku AND b.ingredient_batch_code = p.ingredient_batch_code)""")


def _link_ok(u: str) -> str:
    scheme = f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
    host = f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
    hosts = ", ".join(f"'{h}'" for h in ["drive.google.com", "docs.google.com", "sheets.google.com"])
    return (f"CASE WHEN {u} IS NULL OR {u} = '' THEN TRUE ELSE coalesce({scheme} IN ('http', 'https') AND "
            f"({host} IN ({hosts}) OR {host} LIKE '%.google.com'), FALSE) END")


register("display_functions", f"""
SELECT h.processing_code,
       trim(regexp_replace('  ' || h.processing_code || '   x', '\\s+', ' ', 'g')) AS collapsed,
       coalesce(regexp_full_match(l.production_date, '[0-9]{{6}}'), FALSE) AS is_yymmdd,
       CASE WHEN coalesce(regexp_full_match(l.production_date, '[0-9]{{6}}'), FALSE) THEN
         '20' || substr(l.production_date, 1, 2) || '-' || substr(l.production_date, 3, 2) || '-'
         || substr(l.production_date, 5, 2) END AS date_label,
       strftime(h.created_at, '%H:%M:%S  - %d/%m/%Y') AS created_display,
       {_link_ok('h.machine_setup_url')} AS setup_link_ok,
       {_link_ok('h.processed_data_url')} AS data_link_ok,
       replace(regexp_extract(h.machine_setup_url, '([^/\\\\]*)$', 1), ' ', '_') AS setup_file,
       coalesce(nullif(trim(h.created_by), ''), 'Unknown') AS owner,
       lower(trim(regexp_replace(h.created_by, '^[^:]*:', ''))) AS owner_email,
       coalesce(regexp_full_match(l.partner_code, '[A-Z]{{2}}'), FALSE) AS partner_ok,
       string_split(h.processing_code, ' ')[6] AS suffix_token
FROM compounding_how h LEFT JOIN location_codes l ON l.location_id = h.location_code""")
register("quality_unique_keys", """
SELECT set_code, weight_code, CAST(NULL AS VARCHAR) AS batch_variant_code, count(*) AS n, 'duplicate_key' AS rule,
       'dry_weight_variants: key set_code, weight_code is not unique' AS message
FROM dry_weight_variants GROUP BY set_code, weight_code HAVING count(*) > 1
UNION ALL SELECT set_code, weight_code, batch_variant_code, count(*), 'duplicate_key',
       'batch_variants: key set_code, weight_code, batch_variant_code is not unique'
FROM batch_variants GROUP BY set_code, weight_code, batch_variant_code HAVING count(*) > 1
UNION ALL SELECT set_code, NULL, NULL, count(*), 'duplicate_key', 'ingredient_sets: key set_code is not unique'
FROM ingredient_sets GROUP BY set_code HAVING count(*) > 1""")
register("stream_register_weights", "SELECT request_id, outcome <> 'rejected' AS accepted, set_code, weight_code, rule "
         "FROM (" + SQL["register_weights"] + ") x")
register("stream_register_variants", "SELECT request_id, outcome <> 'rejected' AS accepted, set_code, weight_code, "
         "batch_variant_code, rule FROM (" + SQL["register_variants"] + ") x")

# ---- versioned tables, files, chained streams -------------------------------------------------
register("stream_chain", """
WITH made AS (SELECT set_code FROM (""" + SQL_BODY["register_sets"] + """) WHERE outcome = 'created'),
opt AS (SELECT min(trim(partner_code)) AS p FROM location_partners WHERE trim(partner_code) <> '' AND trim(machine_specification) <> ''),
base AS (SELECT coalesce((SELECT max(next_value) FROM code_counters WHERE counter_name = 'pellet_bag_sequence'
                           AND scope = 'pellet_bag:global'), 0) AS bag, coalesce((SELECT max(next_suffix) FROM conversion1_product_counter), 0) AS product),
l AS (SELECT set_code, set_code || ' AB AB ' || upper(p) || ' 240115' AS loc, row_number() OVER (ORDER BY set_code) - 1 AS i FROM made, opt),
b AS (SELECT loc || ' AB PF ' || printf('%04d', bag + 2 * i + k) AS code FROM l, base, (VALUES (0), (1)) AS v(k)),
c AS (SELECT code || ' ' || upper(p) || ' 240115' AS code FROM b, opt)
SELECT 'sets' AS kind, set_code AS code FROM made
UNION ALL SELECT 'weights', set_code || ' AB' FROM made
UNION ALL SELECT 'variants', set_code || ' AB AB' FROM made
UNION ALL SELECT 'locations', loc FROM l
UNION ALL SELECT 'hows', loc || ' AB' FROM l
UNION ALL SELECT 'bags', code FROM b
UNION ALL SELECT 'contexts', code FROM c
UNION ALL SELECT 'conversion_hows', code || ' AB' FROM c
UNION ALL SELECT 'products', code || ' AB ' || printf('%04d', product + row_number() OVER (ORDER BY code || ' AB') - 1) FROM c, base""")
register("schema_file_problems", """
SELECT * FROM (VALUES ('location_partners', 'machine_specification', 'missing_column', 'string', NULL, 1),
                      ('location_partners', 'created_at', 'wrong_type', 'timestamp_ntz', 'string', 1),
                      ('location_partners', 'region', 'extra_column', NULL, 'string', 1),
                      ('user_roles', NULL, 'missing_table', NULL, NULL, 0)) AS v(table_name, column_name, problem, expected, found, files)""")
register("appended_batches", "SELECT location_id, partner_code, created_at FROM location_codes")
register("changed_snapshots", """
WITH blocked AS (SELECT DISTINCT set_code FROM (""" + _DEPS + """))
SELECT 'bag' AS part, pellet_bag_id AS key, updated_by, remaining_mass_kg AS value FROM (""" + SQL_BODY["patch_bags"] + """)
UNION ALL SELECT 'set', s.set_code, NULL, CAST((SELECT count(*) FROM ingredient_set_items i WHERE i.set_code = s.set_code) AS DOUBLE)
FROM ingredient_sets s WHERE s.set_code IN (SELECT set_code FROM blocked)""")
register("weights_of_set", f"""
SELECT set_code, weight_code, weight_hash, {pairs('items', 'sku', 'wt_percent')} AS items_text FROM v_weights WHERE set_code = 'S1'""")
register("variants_of_weight", f"""
SELECT set_code, weight_code, batch_variant_code, {pairs('items', 'sku', 'ingredient_batch_code')} AS items_text
FROM v_batches WHERE set_code = 'S1' AND weight_code = 'AB'""")
register("role_list", "SELECT email, role_group, is_active FROM user_roles")
register("failure_mode_list", f"""
SELECT m.failure_mode, (SELECT count(*) FROM compounding_how h WHERE h.is_active AND h.failure_mode = m.failure_mode) AS n_hows
FROM (VALUES {", ".join(f"({_lit(m)})" for m in _R.FAILURE_MODES)}) AS m(failure_mode)""")

# ---- kept beside the tables -------------------------------------------------------------------
register("sets_search_indexed", """
SELECT set_code, created_at, array_to_string(sku_list, ',') AS sku_list_text FROM v_sets
WHERE contains(lower(set_code), '_00') OR list_bool_or(list_transform(sku_list, lambda x: contains(lower(x), '_00')))""")
register("bags_search_indexed", """
SELECT pellet_bag_id, pellet_bag_code, compounding_how_code, created_at FROM pellet_bags
WHERE is_active AND lower(pellet_bag_code) LIKE '%pf 000%'""")
register("kpis_by_deltas", f"""
WITH {_BAGS_CTES},
b AS (SELECT bag_mass_kg, qc_status, is_active FROM pellet_bags UNION ALL SELECT bag_mass_kg, qc_status, TRUE FROM bags)
SELECT (SELECT count(*) FROM ingredients WHERE is_active) AS sku_count, count(*) AS active_pellet_bags,
       coalesce(sum(bag_mass_kg), 0.0) AS total_pellets_produced_kg
FROM b WHERE is_active AND NOT coalesce(qc_status = 'Requested', FALSE)""")
register("dependencies_by_deltas", f"""
WITH made AS (SELECT set_code FROM ({SQL_BODY["register_weights"]}) WHERE outcome = 'created')
SELECT set_code, count(*) AS n, 'dry_weight_variants' AS source FROM (SELECT set_code FROM dry_weight_variants UNION ALL SELECT set_code FROM made)
WHERE NOT ends_with(set_code, '7') GROUP BY set_code
UNION ALL SELECT set_code, count(*), 'batch_variants' FROM batch_variants GROUP BY set_code
UNION ALL SELECT set_code, count(*), 'location_codes' FROM location_codes GROUP BY set_code""")
register("suffix_by_deltas", SQL_BODY["next_compounding_suffix"].replace("WHERE is_active", "WHERE is_active AND process_code_suffix <= 'MM'"))
register("locations_deep_page", """
SELECT location_id, partner_code, production_date, created_at FROM location_codes
ORDER BY created_at DESC NULLS LAST, location_id DESC NULLS LAST LIMIT 50 OFFSET 9950""")
register("request_costs", f"""
SELECT 'dashboard' AS request_id, 3 AS query_count, TRUE AS timed,
       1 + (SELECT least(25, count(*)) FROM pellet_bags WHERE is_active AND trim(qc_status) <> ''
            AND lower(trim(qc_status)) NOT IN ({", ".join(_lit(x) for x in _R.QUEUE_EXCLUDED_STATUSES)}))
         + (SELECT least(50, count(*)) FROM location_codes) AS rows_read""")
_CHANGED = V_FLAT
for _a, _b in (("FROM batch_variants v", "FROM bv2 v"), ("JOIN batch_variant_items i", "JOIN bvi2 i"), ("JOIN dry_weight_items i", "JOIN dwi2 i")):
    _CHANGED = _CHANGED.replace(_a, _b)
register("formulations_maintained", f"""
WITH made AS (SELECT v.set_code, v.weight_code, v.batch_variant_code, v.batch_hash, r.actor, r.items
              FROM ({SQL_BODY["register_variants"]}) v JOIN req_variants r ON CAST(r.request_id AS VARCHAR) = v.request_id WHERE v.outcome = 'created'),
bv2 AS (SELECT * FROM (SELECT set_code, weight_code, batch_variant_code, batch_hash, created_at, created_by FROM batch_variants
                       UNION ALL SELECT set_code, weight_code, batch_variant_code, batch_hash, {AS_OF_SQL}, actor FROM made)
        WHERE NOT ends_with(set_code, '7')),
bvi2 AS (SELECT * FROM (SELECT set_code, weight_code, batch_variant_code, sku, ingredient_batch_code FROM batch_variant_items
                        UNION ALL SELECT set_code, weight_code, batch_variant_code, trim(i.sku), trim(i.ingredient_batch_code)
                                  FROM (SELECT set_code, weight_code, batch_variant_code, unnest(items) AS i FROM made))
         WHERE NOT ends_with(set_code, '7')),
dwi2 AS (SELECT set_code, weight_code, sku, CASE WHEN ends_with(set_code, '4') THEN CAST(wt_percent / 2 AS DECIMAL(38, 9)) ELSE wt_percent END AS wt_percent
         FROM dry_weight_items),
flat2 AS ({_CHANGED})
SELECT {FLAT_TEXT} FROM flat2""")
