"""DuckDB SQL for the test-table projection (mirror of ``batchtrace.sources.tpch``).

The driver's correctness check runs each oracle query on DuckDB over the raw test
tables, so every oracle query starts with the CTEs below. ``with_tables(sql)``
prepends exactly the CTEs the query mentions (plus their dependencies).
"""

from __future__ import annotations

import re

from batchtrace.sources import registries as R
from batchtrace.sources.tpch import BAG_STATUS_MIX, T0


def code(e: str) -> str:
    """DuckDB form of int_to_code for 0..675."""
    return f"(chr(CAST(65 + ({e}) // 26 AS INTEGER)) || chr(CAST(65 + ({e}) % 26 AS INTEGER)))"


def code_to_int(e: str) -> str:
    t = f"upper(trim({e}))"
    return (f"(CASE WHEN regexp_full_match({t}, '[A-Z]{{2}}') THEN "
            f"CAST((ascii({t}) - 65) * 26 + ascii(substr({t}, 2, 1)) - 65 AS BIGINT) END)")


def lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def pick(idx: str, values: list) -> str:
    whens = " ".join(f"WHEN ({idx}) = {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE {whens} ELSE NULL END)"


def user(n: str) -> str:
    return f"('u' || CAST({n} AS VARCHAR) || '@example.com')"


def days(ts: str, n: str) -> str:
    return f"({ts} + INTERVAL ({n}) DAY)"


T0_SQL = f"TIMESTAMP '{T0}'"

CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def _cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = sql
    DEPS[name] = deps


_cte("ingredients", [], f"""
SELECT printf('%d_%04d_%d', p_size % 10, p_partkey, p_size) AS sku,
       CAST(p_size % 10 AS BIGINT) AS category_code, p_partkey AS seq, CAST(p_size AS BIGINT) AS pack_size_value,
       CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'L' END AS pack_size_unit,
       p_name AS trade_name_inci, p_brand AS supplier,
       CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS spec_grade,
       coalesce({pick('p_partkey % 7', R.FORMAT_VALUES)}, 'Flakes') AS format,
       {T0_SQL} + INTERVAL (p_partkey) MINUTE AS created_at,
       {T0_SQL} + INTERVAL (p_partkey) MINUTE + INTERVAL (p_size) HOUR AS updated_at,
       {user('p_partkey % 50')} AS created_by, {user('p_partkey % 50')} AS updated_by,
       p_partkey % 10 <> 0 AS is_active,
       CAST(NULL AS VARCHAR) AS msds_object_path, CAST(NULL AS VARCHAR) AS msds_filename,
       CAST(NULL AS VARCHAR) AS msds_content_type, CAST(NULL AS TIMESTAMP) AS msds_uploaded_at
FROM part""")

_cte("ingredient_batches", ["ingredients"], f"""
SELECT i.sku, 'B' || CAST(g.l_suppkey AS VARCHAR) AS ingredient_batch_code, g.first_ship AS received_at,
       CAST(NULL AS VARCHAR) AS notes, g.quantity_value, i.pack_size_unit AS quantity_unit,
       {days('g.first_ship', '1')} AS created_at, {days('g.first_ship', '1')} AS updated_at,
       {user('g.l_suppkey % 50')} AS created_by, {user('g.l_suppkey % 50')} AS updated_by,
       TRUE AS is_active, CAST(NULL AS VARCHAR) AS spec_object_path, CAST(NULL AS TIMESTAMP) AS spec_uploaded_at,
       CASE (g.l_partkey + g.l_suppkey) % 3 WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS archived,
       CASE WHEN (g.l_partkey + g.l_suppkey) % 3 = 1 THEN g.last_ship END AS archived_at,
       CASE WHEN (g.l_partkey + g.l_suppkey) % 3 = 1 THEN {user('g.l_suppkey % 50')} END AS archived_by
FROM (SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship,
             sum(l_quantity) AS quantity_value
      FROM lineitem GROUP BY l_partkey, l_suppkey) g
JOIN ingredients i ON i.seq = g.l_partkey""")

_cte("_rl", ["ingredients"], """
SELECT g.*, i.sku FROM (
  SELECT l_orderkey, l_partkey, sum(l_quantity) AS qty, min(l_suppkey) AS suppkey, min(l_shipdate) AS ship,
         count(*) AS n_lines, max(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey, l_partkey) g
JOIN ingredients i ON i.seq = g.l_partkey""")

_cte("_heads", [], f"""
SELECT o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderstatus, o.o_orderpriority, c.c_nationkey,
       'S' || CAST(o.o_orderkey AS VARCHAR) AS set_code,
       {code('o.o_orderkey % 676')} AS weight_code,
       {code('(o.o_orderkey // 676) % 676')} AS batch_variant_code,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE {user('o.o_custkey % 50')} END AS created_by
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem)""")

_cte("ingredient_set_items", ["_rl", "_heads"], """
SELECT h.set_code, r.sku, h.o_orderdate AS created_at, h.created_by
FROM _rl r JOIN _heads h ON h.o_orderkey = r.l_orderkey""")

_cte("ingredient_sets", ["_rl", "_heads"], f"""
SELECT h.set_code, s.set_hash, h.o_orderdate AS created_at, h.created_by,
       CASE WHEN h.o_orderkey % 4 <> 0 THEN h.o_orderpriority END AS notes,
       {pick('h.o_custkey % 13', R.MATERIAL_WORKSTREAM_OPTIONS)} AS material_workstream
FROM _heads h JOIN (
  SELECT r.l_orderkey, sha256(string_agg(r.sku, '|' ORDER BY r.sku)) AS set_hash
  FROM _rl r GROUP BY r.l_orderkey) s ON s.l_orderkey = h.o_orderkey""")

_cte("_wl", ["_rl", "_heads"], """
SELECT x.*, CAST(printf('%d.%02d', x.centi // 100, x.centi % 100) AS DECIMAL(38,9)) AS wt_percent
FROM (SELECT r.*, h.set_code, h.weight_code, h.o_orderdate, h.created_by,
             CAST(floor(r.qty * 10000 / sum(r.qty) OVER (PARTITION BY r.l_orderkey) + 0.5) AS BIGINT) AS centi
      FROM _rl r JOIN _heads h ON h.o_orderkey = r.l_orderkey) x""")

_cte("dry_weight_items", ["_wl"], """
SELECT set_code, weight_code, sku, wt_percent, o_orderdate AS created_at, created_by FROM _wl""")

_cte("dry_weight_variants", ["_wl", "_heads"], """
SELECT h.set_code, h.weight_code, w.weight_hash, h.o_orderdate AS created_at, h.created_by,
       h.o_orderpriority AS notes
FROM _heads h JOIN (
  SELECT set_code, weight_code,
         sha256(string_agg(sku || '=' || CAST(CAST(wt_percent AS DECIMAL(38,2)) AS VARCHAR), '|' ORDER BY sku))
           AS weight_hash
  FROM _wl GROUP BY set_code, weight_code) w ON w.set_code = h.set_code AND w.weight_code = h.weight_code""")

_cte("batch_variant_items", ["_rl", "_heads"], """
SELECT h.set_code, h.weight_code, h.batch_variant_code, r.sku,
       'B' || CAST(r.suppkey AS VARCHAR) AS ingredient_batch_code, h.o_orderdate AS created_at, h.created_by
FROM _rl r JOIN _heads h ON h.o_orderkey = r.l_orderkey""")

_cte("batch_variants", ["batch_variant_items", "_heads"], """
SELECT h.set_code, h.weight_code, h.batch_variant_code, b.batch_hash, h.o_orderdate AS created_at,
       h.created_by, CAST(NULL AS VARCHAR) AS notes
FROM _heads h JOIN (
  SELECT set_code, weight_code, batch_variant_code,
         sha256(string_agg(sku || '=' || ingredient_batch_code, '|' ORDER BY sku, ingredient_batch_code))
           AS batch_hash
  FROM batch_variant_items GROUP BY set_code, weight_code, batch_variant_code) b
  ON b.set_code = h.set_code AND b.weight_code = h.weight_code AND b.batch_variant_code = h.batch_variant_code""")

_cte("location_partners", [], f"""
SELECT {code('n_nationkey + 10')} AS partner_code, n_name AS partner_name,
       CASE WHEN n_nationkey % 4 <> 0 THEN 'M-' || CAST(n_regionkey AS VARCHAR) END AS machine_specification,
       {days("TIMESTAMP '2023-06-01 00:00:00'", 'n_nationkey')} AS created_at, 'admin@example.com' AS created_by
FROM nation""")

_cte("_loc", ["_heads"], f"""
SELECT x.*, concat_ws(' ', x.location_id, x.process_code_suffix) AS processing_code FROM (
  SELECT h.*, {code('h.c_nationkey + 10')} AS partner_code,
         strftime({days('h.o_orderdate', '3')}, '%y%m%d') AS production_date,
         concat_ws(' ', h.set_code, h.weight_code, h.batch_variant_code, {code('h.c_nationkey + 10')},
                   strftime({days('h.o_orderdate', '3')}, '%y%m%d')) AS location_id,
         {code('h.o_orderkey % 676')} AS process_code_suffix
  FROM _heads h) x""")

_cte("location_codes", ["_loc"], f"""
SELECT set_code, weight_code, batch_variant_code, partner_code, production_date, location_id,
       {days('o_orderdate', '1')} AS created_at, created_by
FROM _loc""")

_cte("compounding_how", ["_loc"], f"""
SELECT processing_code, location_id AS location_code, process_code_suffix,
       {pick('o_orderkey % 13', R.FAILURE_MODES)} AS failure_mode,
       CASE WHEN o_orderkey % 5 = 0 THEN 'https://docs.google.com/d/' || CAST(o_orderkey AS VARCHAR)
            WHEN o_orderkey % 5 = 1 THEN 'http://example.com/d/' || CAST(o_orderkey AS VARCHAR) END
         AS machine_setup_url,
       CASE WHEN o_orderkey % 7 = 0 THEN 'https://drive.google.com/f/' || CAST(o_orderkey AS VARCHAR) END
         AS processed_data_url,
       CAST(NULL AS VARCHAR) AS notes,
       {days('o_orderdate', '2')} AS created_at, {days('o_orderdate', '2')} AS updated_at,
       created_by, created_by AS updated_by, o_orderstatus <> 'P' AS is_active
FROM _loc""")

_cte("_bags", ["_rl", "_loc"], f"""
SELECT y.*, concat_ws(' ', y.processing_code, y.product_type, printf('%04d', y.sequence_number)) AS pellet_bag_code
FROM (SELECT r.*, l.processing_code, l.created_by,
             {pick('r.l_partkey % 3', R.PRODUCT_TYPES)} AS product_type,
             CAST(row_number() OVER (PARTITION BY r.l_orderkey ORDER BY r.l_partkey) AS BIGINT) AS sequence_number
      FROM _rl r JOIN _loc l ON l.o_orderkey = r.l_orderkey) y""")


def _status(a: int, b: int) -> str:
    return pick(f"(l_orderkey * {a} + l_partkey * {b}) % {len(BAG_STATUS_MIX)}", BAG_STATUS_MIX)


def _assignee(a: int) -> str:
    return (f"CASE WHEN (l_orderkey + l_partkey * {a}) % 4 <> 0 THEN "
            f"'a' || CAST((l_orderkey + l_partkey) % 6 AS VARCHAR) || '@example.com' END")


_cte("pellet_bags", ["_bags"], f"""
SELECT 'PB-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS pellet_bag_id,
       pellet_bag_code, string_split(pellet_bag_code, ' ') AS pellet_bag_code_tokens,
       processing_code AS compounding_how_code, product_type, sequence_number,
       qty AS bag_mass_kg, qty - n_lines * 4 AS remaining_mass_kg, tax AS short_moisture_percent,
       {pick('(l_orderkey + l_partkey) % 9', R.PURPOSE_OPTIONS)} AS purpose,
       {pick('l_partkey % 3', R.REFERENCE_SAMPLE_OPTIONS)} AS reference_sample_taken,
       {_status(1, 1)} AS qc_status, {_status(1, 2)} AS long_moisture_status, {_status(3, 1)} AS density_status,
       {_status(1, 5)} AS injection_moulding_status, {_status(7, 1)} AS film_forming_status,
       {_assignee(1)} AS long_moisture_assignee_email, {_assignee(2)} AS density_assignee_email,
       {_assignee(3)} AS injection_moulding_assignee_email, {_assignee(5)} AS film_forming_assignee_email,
       CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS VARCHAR) AS customer,
       ship AS created_at, {days('ship', 'l_partkey % 30')} AS updated_at,
       created_by, created_by AS updated_by, (l_orderkey + l_partkey) % 9 <> 0 AS is_active
FROM _bags""")

_cte("pellet_bag_assignees", [], f"""
SELECT 'a' || CAST(n AS VARCHAR) || '@example.com' AS email, n <> 5 AS is_active,
       {T0_SQL} AS created_at, 'admin@example.com' AS created_by
FROM (SELECT DISTINCT s_suppkey % 8 AS n FROM supplier)""")

_cte("_ctx", ["_bags"], f"""
SELECT x.*, concat_ws(' ', x.context_code, x.process_code) AS conversion1_how_code FROM (
  SELECT b.*, {code('b.l_orderkey % 25 + 10')} AS partner_code,
         strftime({days('b.ship', '10')}, '%y%m%d') AS date_yymmdd,
         concat_ws(' ', b.pellet_bag_code, {code('b.l_orderkey % 25 + 10')},
                   strftime({days('b.ship', '10')}, '%y%m%d')) AS context_code,
         {days('b.ship', '10')} AS ctx_created, {code('b.l_partkey % 676')} AS process_code
  FROM _bags b WHERE b.product_type = 'PF') x""")

_cte("conversion1_context", ["_ctx"], """
SELECT context_code, pellet_bag_code, partner_code, 'M' || CAST(l_partkey % 5 AS VARCHAR) AS machine_code,
       date_yymmdd, ctx_created AS created_at, created_by, ctx_created AS updated_at, created_by AS updated_by,
       (l_orderkey + l_partkey) % 6 <> 0 AS is_active
FROM _ctx""")

_cte("conversion1_how", ["_ctx"], f"""
SELECT conversion1_how_code, context_code, process_code, process_code AS processing_code,
       {pick('(l_orderkey + l_partkey) % 13', R.FAILURE_MODES)} AS failure_mode,
       CAST(NULL AS VARCHAR) AS machine_setup_url, CAST(NULL AS VARCHAR) AS processed_data_url,
       {days('ctx_created', '1')} AS created_at, created_by, CAST(NULL AS TIMESTAMP) AS updated_at,
       CAST(NULL AS VARCHAR) AS updated_by, (l_orderkey + l_partkey) % 7 <> 0 AS is_active
FROM _ctx""")

_cte("conversion1_products", ["_ctx"], f"""
SELECT conversion1_how_code || ' ' || printf('%04d', i) AS product_code, conversion1_how_code,
       printf('%04d', i) AS product_suffix,
       {pick('(l_orderkey + i) % 4', R.STORAGE_LOCATION_OPTIONS)} AS storage_location,
       CAST(NULL AS VARCHAR) AS notes, CAST(qty AS BIGINT) AS number_units_produced,
       (l_orderkey + i) % 2 = 0 AS numbered_in_order,
       {pick('(l_orderkey + i) % 9', R.TENSILE_STATUS_OPTIONS)} AS tensile_rigid_status,
       {pick('(l_partkey + i) % 9', R.TENSILE_STATUS_OPTIONS)} AS tensile_films_status,
       {pick('(l_partkey + i) % 6', R.OTHER_STATUS_OPTIONS)} AS seal_strength_status,
       CAST(NULL AS VARCHAR) AS shelf_stability_status, CAST(NULL AS VARCHAR) AS solubility_status,
       CAST(NULL AS VARCHAR) AS defect_analysis_status, CAST(NULL AS VARCHAR) AS blocking_status,
       CAST(NULL AS VARCHAR) AS film_emc_status, CAST(NULL AS VARCHAR) AS friction_status,
       CAST(NULL AS BIGINT) AS width_mm, CAST(NULL AS BIGINT) AS length_m,
       CAST(NULL AS BIGINT) AS avg_film_thickness_um, CAST(NULL AS DOUBLE) AS sd_film_thickness,
       CAST(NULL AS DOUBLE) AS film_thickness_variation_percent,
       {days('ctx_created', '2')} AS created_at, created_by, CAST(NULL AS TIMESTAMP) AS updated_at,
       CAST(NULL AS VARCHAR) AS updated_by, (l_orderkey + l_partkey) % 5 <> 0 AS is_active
FROM (SELECT c.*, unnest(range(0, CAST(c.l_orderkey % 3 AS BIGINT) + 1)) AS i FROM _ctx c)""")

_ROLE = pick("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 "
             "WHEN 'MACHINERY' THEN 3 ELSE 4 END",
             ["admin", "sku_codes", "formulations", "formulations_mix", "mixing_2"])

_cte("user_roles", [], f"""
SELECT CASE WHEN c_custkey < 50 THEN {user('c_custkey')} ELSE lower(c_name) || '@example.com' END AS email,
       'F' || CAST(c_custkey AS VARCHAR) AS first_name,
       CAST(NULL AS VARCHAR) AS last_name,
       CASE WHEN c_custkey % 5 = 0 THEN upper({_ROLE}) || ' ' ELSE {_ROLE} END AS role_group,
       CAST(NULL AS VARCHAR[]) AS permissions,
       c_custkey % 7 <> 0 AS is_active, {T0_SQL} + INTERVAL (c_custkey) MINUTE AS created_at,
       'admin@example.com' AS created_by, CAST(NULL AS TIMESTAMP) AS updated_at, CAST(NULL AS VARCHAR) AS updated_by
FROM customer""")

_cte("conversion1_product_counter", ["conversion1_products"], f"""
SELECT 'global' AS id, max(CAST(product_suffix AS BIGINT)) + 1 AS next_suffix, {T0_SQL} AS updated_at
FROM conversion1_products""")

_cte("code_counters", ["ingredient_sets", "dry_weight_variants", "batch_variants", "location_partners",
                       "pellet_bags", "ingredients"], f"""
SELECT 'set_code' AS counter_name, '' AS scope, coalesce(max({code_to_int('set_code')}), 0) + 1 AS next_value,
       {T0_SQL} AS updated_at FROM ingredient_sets
UNION ALL
SELECT 'weight_code', set_code, max({code_to_int('weight_code')}) + 1, {T0_SQL}
FROM dry_weight_variants GROUP BY set_code
UNION ALL
SELECT 'batch_variant_code', set_code || ' ' || weight_code, max({code_to_int('batch_variant_code')}) + 1, {T0_SQL}
FROM batch_variants GROUP BY set_code, weight_code
UNION ALL
SELECT 'location_partner_code', '', greatest(max({code_to_int('partner_code')}) + 1, {R.PARTNER_CODE_START}),
       {T0_SQL} FROM location_partners
UNION ALL
SELECT 'pellet_bag_sequence', 'pellet_bag:global', max(sequence_number) + 1, {T0_SQL} FROM pellet_bags
UNION ALL
SELECT 'ingredient_seq', 'global', max(seq) + 1, {T0_SQL} FROM ingredients""")

# ---- request batches (mirror of TpchDomain.req_*) ----------------------------------------
_cte("_ol", ["_rl", "_heads"], """
SELECT r.*, h.set_code, h.weight_code, h.batch_variant_code, h.o_orderdate, h.created_by, h.o_orderpriority,
       h.o_custkey, r.qty * 100 / sum(r.qty) OVER (PARTITION BY r.l_orderkey) AS pct
FROM _rl r JOIN _heads h ON h.o_orderkey = r.l_orderkey""")

_cte("req_sets", ["_ol"], f"""
SELECT l_orderkey AS request_id, {days('o_orderdate', '30')} AS submitted_at, CASE l_orderkey % 50 WHEN 0 THEN [first(sku ORDER BY l_partkey)] WHEN 1 THEN ['0_0000_0', first(sku ORDER BY l_partkey)]
            ELSE list(sku ORDER BY l_partkey) END AS skus,
       CASE WHEN l_orderkey % 3 = 0 THEN o_orderpriority END AS notes,
       CAST(NULL AS VARCHAR) AS material_workstream, created_by AS actor
FROM _ol GROUP BY l_orderkey, o_orderdate, o_orderpriority, created_by""")

_cte("req_weights", ["_ol"], f"""
SELECT l_orderkey AS request_id, {days('o_orderdate', '31')} AS submitted_at,
       CASE WHEN l_orderkey % 11 = 0 THEN 'ZZ' ELSE set_code END AS set_code,
       list({{'sku': CASE WHEN l_orderkey % 7 = 0 AND i = 1 THEN '0_0000_0' ELSE sku END,
              'wt_percent': CASE WHEN l_orderkey % 3 = 0 THEN mirrored ELSE pct END}} ORDER BY i) AS items,
       CAST(NULL AS VARCHAR) AS notes, created_by AS actor
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i,
             list(pct) OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC
                             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)[
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey)] AS mirrored FROM _ol)
GROUP BY l_orderkey, o_orderdate, set_code, created_by""")

_cte("req_variants", ["_ol"], f"""
SELECT o.l_orderkey AS request_id, {days('o.o_orderdate', '32')} AS submitted_at, o.set_code,
       CASE WHEN o.l_orderkey % 9 = 0 THEN 'ZZ' ELSE o.weight_code END AS weight_code,
       list({{'sku': o.sku, 'ingredient_batch_code': CASE WHEN o.l_orderkey % 5 = 0 AND o.i = 1 THEN 'B0'
                                                        ELSE 'B' || CAST(m.maxsupp AS VARCHAR) END}} ORDER BY o.l_partkey) AS items,
       o.created_by AS actor
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS i FROM _ol) o JOIN (SELECT l_orderkey, l_partkey, max(l_suppkey) AS maxsupp FROM lineitem GROUP BY l_orderkey, l_partkey) m
  ON m.l_orderkey = o.l_orderkey AND m.l_partkey = o.l_partkey
GROUP BY o.l_orderkey, o.o_orderdate, o.set_code, o.weight_code, o.created_by""")

_cte("req_ingredients", [], f"""
SELECT 'I' || CAST(g.l_partkey AS VARCHAR) || '-' || CAST(g.l_suppkey AS VARCHAR) AS request_id,
       g.first_ship AS submitted_at, CAST(p.p_size % 10 AS BIGINT) AS category_code, p.p_name AS trade_name_inci,
       CASE WHEN (g.l_partkey + g.l_suppkey) % 4 = 0 THEN p.p_brand ELSE s.s_name END AS supplier,
       CASE WHEN g.l_partkey % 3 <> 0 THEN p.p_type END AS spec_grade,
       coalesce({pick('g.l_partkey % 7', R.FORMAT_VALUES)}, 'Flakes') AS format,
       CAST(p.p_size + (g.l_suppkey % 2) * 5 AS BIGINT) AS pack_size_value,
       CASE WHEN p.p_size % 2 = 0 THEN 'kg' ELSE 'L' END AS pack_size_unit,
       {user('g.l_suppkey % 50')} AS actor
FROM (SELECT l_partkey, l_suppkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_partkey, l_suppkey) g
JOIN part p ON p.p_partkey = g.l_partkey JOIN supplier s ON s.s_suppkey = g.l_suppkey""")

_IMP_CAT = "(CASE WHEN p_partkey % 7 = 0 THEN p_size % 10 ELSE (p_size + 1) % 10 END)"
_cte("req_imports", [], f"""
SELECT 'X' || CAST(p_partkey AS VARCHAR) AS request_id,
       TIMESTAMP '2024-06-01 00:00:00' + INTERVAL (p_partkey) MINUTE AS submitted_at,
       CASE WHEN p_partkey % 5 = 0 THEN replace(printf('%d_%04d_%d', {_IMP_CAT}, p_partkey, p_size), '_', '')
            ELSE printf('%d_%04d_%d', {_IMP_CAT}, p_partkey, p_size) END AS sku,
       CAST({_IMP_CAT} AS BIGINT) AS category_code, p_name AS trade_name_inci, p_brand AS supplier,
       CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS spec_grade,
       coalesce({pick('p_partkey % 7', R.FORMAT_VALUES)}, 'Flakes') AS format,
       CAST(CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_size END AS BIGINT) AS pack_size_value,
       CASE WHEN p_size % 2 = 0 THEN 'kg' ELSE 'L' END AS pack_size_unit,
       {user('p_partkey % 50')} AS actor
FROM part""")

_cte("req_locations", ["_heads"], f"""
SELECT o_orderkey AS request_id, {days('o_orderdate', '5')} AS submitted_at, set_code, weight_code, batch_variant_code,
       {code('o_custkey % 40')} AS partner_code, strftime({days('o_orderdate', '7')}, '%y%m%d') AS production_date,
       created_by AS actor
FROM _heads""")

_cte("req_partners", [], f"""
SELECT s_suppkey AS request_id, {T0_SQL} + INTERVAL (s_suppkey) MINUTE AS submitted_at, s_name AS partner_name,
       'M' || CAST(s_nationkey AS VARCHAR) AS machine_specification, 'admin@example.com' AS actor
FROM supplier""")

_cte("req_hows", ["_loc"], f"""
SELECT o_orderkey AS request_id, {days('o_orderdate', '9')} AS submitted_at, location_id AS location_code,
       lower({code('(o_orderkey // 7) % 676')}) AS process_code_suffix,
       coalesce({pick('o_orderkey % 14', R.FAILURE_MODES)}, 'Jammed') AS failure_mode,
       CAST(NULL AS VARCHAR) AS machine_setup_url, CAST(NULL AS VARCHAR) AS processed_data_url,
       CAST(NULL AS VARCHAR) AS notes, created_by AS actor
FROM _loc""")

_cte("req_bags", ["_loc", "_rl"], f"""
SELECT l.o_orderkey AS request_id, {days('l.o_orderdate', '12')} AS submitted_at,
       ' ' || l.processing_code AS compounding_how_code, lower({pick('l.o_orderkey % 3', R.PRODUCT_TYPES)}) AS product_type,
       m.mass AS bag_mass_kg, CAST(l.o_orderkey % 5 + 1 AS INTEGER) AS number_of_bags,
       CASE WHEN l.o_orderkey % 29 = 0 THEN -5.0 WHEN l.o_orderkey % 3 = 0 THEN m.mass / 2 END AS remaining_mass_kg,
       {pick('l.o_orderkey % 5', R.QC_STATUS_OPTIONS)} AS qc_status,
       CASE WHEN l.o_orderkey % 19 = 0 THEN 'Bogus' ELSE {pick('l.o_orderkey % 9', R.PURPOSE_OPTIONS)} END AS purpose,
       {pick('l.o_orderkey % 12', BAG_STATUS_MIX)} AS density_status,
       CASE WHEN l.o_orderkey % 2 = 0 THEN ' a1@example.com ' END AS density_assignee_email,
       l.o_orderkey % 100 / 10 AS short_moisture_percent,
       CASE WHEN l.o_orderkey % 4 = 0 THEN '  ' ELSE 'first run' END AS notes, 'Acme' AS customer, l.created_by AS actor
FROM _loc l JOIN (SELECT l_orderkey, sum(qty) AS mass FROM _rl GROUP BY l_orderkey) m ON m.l_orderkey = l.o_orderkey""")

_cte("req_contexts", ["_ctx"], f"""
SELECT 'C' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS request_id,
       {days('ship', '25')} AS submitted_at, pellet_bag_code, partner_code,
       'M-' || CAST(n_regionkey AS VARCHAR) AS machine_code,
       CASE WHEN l_partkey % 37 = 0 THEN '240230' ELSE
         strftime({days('ship', 'CASE WHEN (l_orderkey + l_partkey) % 2 = 0 THEN 10 ELSE 20 END')}, '%y%m%d') END AS date_yymmdd,
       created_by AS actor
FROM _ctx LEFT JOIN nation ON n_nationkey % 25 = l_orderkey % 25""")

_cte("req_conversion_hows", ["_ctx"], f"""
SELECT 'H' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS request_id,
       {days('ship', '26')} AS submitted_at, context_code, '' AS process_code,
       CASE WHEN l_partkey % 2 = 0 THEN {code('(l_orderkey + l_partkey) % 676')} ELSE '' END AS processing_code,
       CASE WHEN l_partkey % 2 = 0 THEN 'save' ELSE 'generate' END AS submit_action,
       CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE {pick('l_orderkey % 13', R.FAILURE_MODES)} END AS failure_mode,
       CAST(NULL AS VARCHAR) AS machine_setup_url, CAST(NULL AS VARCHAR) AS processed_data_url, created_by AS actor
FROM _ctx""")

_cte("req_products", ["_ctx"], f"""
SELECT 'P' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS request_id,
       {days('ship', '27')} AS submitted_at, conversion1_how_code,
       CAST(l_orderkey % 3 + 1 AS INTEGER) AS number_of_records,
       {pick('l_partkey % 10', R.STORAGE_LOCATION_OPTIONS)} AS storage_location,
       {pick('l_orderkey % 11', R.TENSILE_STATUS_OPTIONS)} AS tensile_rigid_status,
       CASE WHEN l_partkey % 4 = 0 THEN 'Ready' END AS tensile_films_status,
       CASE WHEN l_partkey % 23 = 0 THEN 'Bogus' ELSE {pick('l_partkey % 7', R.OTHER_STATUS_OPTIONS)} END AS solubility_status,
       CASE WHEN l_orderkey % 2 = 0 THEN ' roll ' END AS notes, l_orderkey % 300 AS width_mm,
       l_orderkey % 2 = 1 AS numbered_in_order, l_partkey % 10 / 4 AS sd_film_thickness, created_by AS actor
FROM _ctx""")

# ---- change batches (mirror of TpchDomain.chg_*) and the document manifest ----------------
_cte("chg_roles", [], """
SELECT CASE WHEN event_id % 41 = 7 THEN '  ' WHEN event_id % 10 = 0 THEN 'new' || CAST(user_id AS VARCHAR) || '@example.com'
            WHEN event_id % 10 = 1 THEN 'idp.example.com:customer#' || printf('%09d', user_id) || '@example.com'
            ELSE '  CUSTOMER#' || printf('%09d', user_id) || '@EXAMPLE.COM ' END AS email,
       'N' || CAST(user_id AS VARCHAR) AS first_name, event_type AS last_name,
       CASE WHEN event_id % 13 = 3 THEN ' Owner ' WHEN event_id % 37 = 5 THEN NULL ELSE
       CASE event_type WHEN 'view' THEN 'formulations' WHEN 'click' THEN 'sku_codes' WHEN 'purchase' THEN 'mixing_1'
                       WHEN 'error' THEN 'admin' ELSE 'formulations_mix' END END AS role_group,
       CAST(NULL AS VARCHAR[]) AS permissions, value > 2.0 AS is_active, 'admin@example.com' AS actor, ts, event_id
FROM events""")

_cte("chg_floors", ["_heads"], """
SELECT 'ingredient_seq' AS counter_name, 'global' AS scope, max(p_partkey) + 6 AS next_value FROM part
UNION ALL SELECT 'weight_code', set_code, o_orderkey * 7 % 676 FROM _heads""")

_cte("chg_bags", ["_bags"], f"""
SELECT 'PB-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS pellet_bag_id,
       pellet_bag_code, CASE WHEN l_partkey % 31 = 0 THEN -1.0 WHEN l_orderkey % 2 = 0 THEN (qty - n_lines) / 2 END AS remaining_mass_kg,
       CASE WHEN l_partkey % 3 = 0 THEN 'checked ' || strftime(ship, '%y%m%d') END AS notes,
       CAST(NULL AS VARCHAR) AS customer, 'Planned' AS qc_status, {user('l_orderkey % 7')} AS actor, ship AS submitted_at
FROM _bags WHERE sequence_number = 1
UNION ALL
SELECT 'PB-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR), pellet_bag_code, NULL,
       CASE WHEN l_partkey % 2 = 0 THEN 'second check' END, 'Acme', NULL, 'editor@example.com', {days('ship', '1')}
FROM _bags WHERE sequence_number = 1 AND l_orderkey % 4 = 0""")

_cte("chg_products", ["conversion1_products"], """
SELECT product_code, 'FM Warehouse' AS storage_location, CAST(NULL AS VARCHAR) AS notes,
       'Ready' AS tensile_rigid_status, 'admin@example.com' AS actor
FROM conversion1_products WHERE product_suffix = '0000'""")

_cte("chg_archive", ["ingredient_batches"], """
SELECT sku, ingredient_batch_code, quantity_value > 100 AS archived, 'admin@example.com' AS actor
FROM ingredient_batches WHERE archived IS NULL""")

_cte("chg_status", ["_bags"], f"""
SELECT pellet_bag_code,
       {pick('l_orderkey % 5', R.EDITABLE_STATUS_COLUMNS + ['qc_status'])} AS status_column,
       {pick('l_partkey % 6', ['Recieved', 'Failed', 'Complete', 'Planned', 'Bogus', 'In Progress'])} AS status_value,
       CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'a' || CAST((l_orderkey + l_partkey) % 8 AS VARCHAR) || '@example.com'
       END AS assigned_value,
       {user('l_orderkey % 7')} AS actor, ship AS submitted_at
FROM _bags WHERE sequence_number = 2""")

_cte("chg_hows", ["_loc"], f"""
SELECT processing_code, {pick('(o_orderkey + 1) % 13', R.FAILURE_MODES)} AS failure_mode, ' ' AS machine_setup_url,
       'https://drive.google.com/r/' || CAST(o_orderkey AS VARCHAR) AS processed_data_url, 'revised' AS notes,
       'admin@example.com' AS actor, o_orderdate AS submitted_at
FROM _loc
UNION ALL
SELECT processing_code, 'N/A', NULL, '', 'revised again', 'editor@example.com', {days('o_orderdate', '1')}
FROM _loc WHERE o_orderkey % 3 = 0""")

_cte("chg_set_meta", ["_heads"], f"""
SELECT set_code, upper(o_orderpriority) AS notes,
       {pick('o_custkey % 12', R.MATERIAL_WORKSTREAM_OPTIONS)} AS material_workstream, 'editor@example.com' AS actor,
       o_orderdate AS submitted_at
FROM _heads
UNION ALL
SELECT set_code, NULL, NULL, 'second@example.com', {days('o_orderdate', '1')} FROM _heads WHERE o_custkey % 2 = 0""")

_cte("doc_manifest", ["ingredients"], """
SELECT sku, fname AS filename, CASE seq % 9 WHEN 0 THEN 'image/png' WHEN 1 THEN 'Application/PDF'
                                            ELSE 'application/pdf' END AS content_type,
       seq * 12345 * n AS size_bytes, seq % 2 = 0 AS confirm_replace, created_at + INTERVAL (n) HOUR AS uploaded_at,
       'msds/ingredients/' || sku || '/' || CAST(n AS VARCHAR) || '_' || replace(fname, ' ', '_') AS object_path,
       'admin@example.com' AS actor
FROM (SELECT CASE WHEN seq % 17 = 0 THEN 'X' || sku ELSE sku END AS sku, seq, created_at, n,
             CASE WHEN seq % 9 = 0 THEN 'photo ' || CAST(n AS VARCHAR) || '.png'
                  ELSE 'sheet ' || CAST(n AS VARCHAR) || '.pdf' END AS fname
      FROM ingredients, (SELECT unnest([1, 2]) AS n))""")

_cte("audit_log", [], """
SELECT CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS event_type, CAST(NULL AS VARCHAR) AS actor,
       CAST(NULL AS TIMESTAMP) AS event_at, CAST(NULL AS VARCHAR) AS entity_type, CAST(NULL AS VARCHAR) AS entity_id,
       CAST(NULL AS VARCHAR) AS payload_json
WHERE FALSE""")

_cte("query_log", [], """
SELECT CAST(user_id AS VARCHAR) AS request_id, value AS elapsed_ms, event_id AS query_id, ts AS logged_at
FROM events""")


def _needed(sql: str) -> list[str]:
    found = [n for n in CTES if re.search(rf"\b{re.escape(n)}\b", sql)]
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DEPS[n]:
            visit(d)
        order.append(n)

    for n in found:
        visit(n)
    return order


def with_tables(sql: str) -> str:
    """Prefix ``sql`` with the projection CTEs it references."""
    names = _needed(sql)
    if not names:
        return sql
    body = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {body},\n{sql[5:]}"
    return f"WITH {body}\n{sql}"
