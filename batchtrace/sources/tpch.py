"""Projection of the driver's TPC-H-like test tables onto the traceability domain.

This module only *shapes input*: it maps columns of ``part``, ``lineitem``,
``orders``, ``customer``, ``nation`` and ``supplier`` onto the 20 base tables
with fixed integer/string rules. It does none of the query work; every query in
``batchtrace.plans`` runs on these tables exactly as it would on real snapshots.
The same rules are written in DuckDB SQL in ``batchtrace.plans.oracle_tables``.

Rules (all keys are the TPC-H keys):
  ingredients        one per part; category = size % 10, seq = partkey, pack = size
  ingredient_batches one per (partkey, suppkey) in lineitem; code 'B<suppkey>'
  recipe lines       lineitem grouped by (orderkey, partkey): one SKU per line group
  formulation        one per order with lines: set = 'S<orderkey>', so sets are never shared or
                     wrapped; weight and variant are two-letter codes inside the set
  sets / weights     every order's lines are its set items and its dry weights
  location, how      one per order; bags one per recipe line; conversion chain for PF bags
  partners           one per nation, code(nationkey + 10) (overlaps the defaults)
  user_roles         one per customer, role by market segment
  req_*              request batches for the registration jobs (orders, parts, suppliers)
  chg_*              change batches for the table-change jobs (events, bags, products, ...)

``domain(spark, sf_dir)`` returns a ``StoredDomain``: each table is written once as a
typed Parquet snapshot under ``spark.checkpoint.dir`` (keyed by code version and source
file fingerprint) and scanned back with ``schemas.read_table``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from batchtrace.functions import codes as C, hashing as H, text as TX
from batchtrace.sources import registries as R
from batchtrace.sources.schemas import FILE_OPTIONS, SCHEMAS, clustered, evolve, read_table

BAG_SCOPE = "pellet_bag:global"
T0 = "2024-01-01 00:00:00"


def _pick(idx, values: list) -> F.Column:
    """values[idx]; an index past the list gives NULL (used to mix in NULLs)."""
    # an array, not a CASE of every value: many of these make a row, and Java compiles no huge methods
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), idx.cast("int"))


def _user(n) -> F.Column:
    return F.concat(F.lit("u"), n.cast("string"), F.lit("@example.com"))


def _batch(suppkey) -> F.Column:
    return F.concat(F.lit("B"), suppkey.cast("string"))


def _days(ts: F.Column, n) -> F.Column:
    n = n if isinstance(n, F.Column) else F.lit(n)
    return F.timestamp_add("DAY", n, ts)


# Status values mixed into bags: blanks, legacy spelling, terminal and open states.
BAG_STATUS_MIX = [None, " ", "Not Requested", "Requested", "Recieved", "Received", "Planned",
                  "In Progress", "Complete", "Not received", "Failed", "Testing Complete"]


def _sku(size, key) -> F.Column:
    return C.format_sku(size % 10, key, size)


def _item_sku(item: F.Column) -> F.Column:
    return _sku(item["p_size"], item["l_partkey"])


def _total() -> F.Column:
    """Quantity of all recipe lines of an order key, once for each of its heads."""
    return F.col("mass") * F.col("n_heads")


def _of_items(value) -> F.Column:
    """``value(item)`` of each recipe line of a head's order key, once for each of its heads."""
    return F.transform(F.when(F.col("n_heads") == 1, F.col("items")).otherwise(
        F.flatten(F.array_repeat("items", F.col("n_heads").cast("int")))), value)


def _centi(qty: F.Column) -> F.Column:
    return F.floor(qty * 10000 / _total() + 0.5).cast("long")


def _wt_percent(qty: F.Column) -> F.Column:
    text = F.format_string("%d.%02d", F.floor(_centi(qty) / 100).cast("long"), _centi(qty) % 100).cast("decimal(38,9)")
    # a text is written and parsed only where there is no whole number of hundredths from 0 on
    return F.when(_centi(qty) >= 0, (_centi(qty).cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,9)")).otherwise(text)


#: Tables that ``TpchDomain`` shapes in the order of their keys, which begin with the set code.
BY_SET = {"ingredient_sets", "ingredient_set_items", "dry_weight_variants", "dry_weight_items", "batch_variants",
          "batch_variant_items", "location_codes", "compounding_how", "pellet_bags", "conversion1_context",
          "conversion1_how", "conversion1_products"}


class TpchDomain:
    """Lazily built domain tables over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, keep=lambda name, df: df):
        """``keep`` stores a frame that many tables are shaped from and returns it as stored."""
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._keep = keep

    def src(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    # ---- shared shapes -------------------------------------------------------------
    @cached_property
    def _order_rows(self) -> DataFrame:
        """One row per order head, with its recipe lines (one per part row, in part-key order) as an
        array: what the tables of an order are shaped from, row by row and without another shuffle.
        ``mass`` is the lines' quantity; ``head_no`` numbers the ``n_heads`` heads of an order key."""
        part = self.src("part").where("p_partkey IS NOT NULL").select(
            F.col("p_partkey").alias("l_partkey"), "p_size",
            F.row_number().over(Window.partitionBy("p_partkey").orderBy("p_size")).alias("copy"))
        li = self.src("lineitem").where("l_orderkey IS NOT NULL").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_tax")
        # dealt out by order once: both groupings and the join below keep that partitioning
        lines = li.join(part, "l_partkey", "left").repartition("l_orderkey").groupBy("l_orderkey", "l_partkey", "copy", "p_size").agg(
            F.sum("l_quantity").alias("qty"), F.min("l_suppkey").alias("suppkey"), F.max("l_suppkey").alias("maxsupp"),
            F.min("l_shipdate").alias("ship"), F.count(F.lit(1)).alias("n_lines"), F.max("l_tax").alias("tax"))
        found = F.col("copy").isNotNull()  # a line without a part counts for its order's head only
        line = F.struct("l_partkey", "copy", "p_size", "qty", "suppkey", "maxsupp", "ship", "n_lines", "tax")
        items = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.sort_array(F.collect_list(F.when(found, line))).alias("items"), F.sum(F.when(found, F.col("qty"))).alias("mass"))
        cols = ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "c_nationkey"]
        c = self.src("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        w = Window.partitionBy("o_orderkey")
        heads = self.src("orders").where("o_orderkey IS NOT NULL").join(c, "o_custkey").select(
            *cols, F.count(F.lit(1)).over(w).alias("n_heads"), F.row_number().over(w.orderBy(*cols[1:])).alias("head_no"))
        return heads.join(items, "o_orderkey")

    @cached_property
    def order_heads(self) -> DataFrame:
        return self._keep("order_rows", self._order_rows).select(
            "*", F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("set_code"),
            C.int_to_code(F.col("o_orderkey") % 676).alias("weight_code"),
            C.int_to_code(F.floor(F.col("o_orderkey") / 676) % 676).alias("batch_variant_code"),
            F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("string"))
             .otherwise(_user(F.col("o_custkey") % 50)).alias("created_by"))

    @cached_property
    def _sorted_heads(self) -> DataFrame:
        """Order heads by set code inside each task: the tables of ``BY_SET`` come out in key order
        (their keys begin with the set code), and the narrow heads are sorted, not the wide rows."""
        return self.order_heads.sortWithinPartitions("set_code")

    def _lines_of(self, heads: DataFrame) -> DataFrame:
        """Recipe lines of every head; ``tot`` and ``sequence_number`` go over all heads of an order key."""
        e = heads.select("*", F.posexplode("items").alias("_pos", "_item"))
        return e.select(
            *[c for c in heads.columns if c not in ("items", "o_orderkey")], F.col("o_orderkey").alias("l_orderkey"), "_item.*",
            _item_sku(F.col("_item")).alias("sku"), _total().alias("tot"),
            (F.col("_pos") * F.col("n_heads") + F.col("head_no")).cast("long").alias("sequence_number"))

    # ---- base tables ---------------------------------------------------------------
    @cached_property
    def ingredients(self) -> DataFrame:
        p = self.src("part")
        created = F.timestamp_add("MINUTE", F.col("p_partkey"), F.lit(T0).cast("timestamp_ntz"))
        df = p.select(
            _sku(F.col("p_size"), F.col("p_partkey")).alias("sku"),
            (F.col("p_size") % 10).cast("long").alias("category_code"),
            F.col("p_partkey").alias("seq"),
            F.col("p_size").cast("long").alias("pack_size_value"),
            F.when(F.col("p_size") % 2 == 0, "kg").otherwise("L").alias("pack_size_unit"),
            F.col("p_name").alias("trade_name_inci"),
            F.col("p_brand").alias("supplier"),
            F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("spec_grade"),
            F.coalesce(_pick(F.col("p_partkey") % 7, R.FORMAT_VALUES), F.lit("Flakes")).alias("format"),
            created.alias("created_at"),
            F.timestamp_add("HOUR", F.col("p_size"), created).alias("updated_at"),
            _user(F.col("p_partkey") % 50).alias("created_by"),
            _user(F.col("p_partkey") % 50).alias("updated_by"),
            (F.col("p_partkey") % 10 != 0).alias("is_active"))
        return evolve(df, SCHEMAS["ingredients"])

    @cached_property
    def ingredient_batches(self) -> DataFrame:
        # dealt out by part once: the grouping and the join keep that partitioning
        li = self.src("lineitem").repartition("l_partkey")
        g = li.groupBy("l_partkey", "l_suppkey").agg(
            F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"),
            F.sum("l_quantity").alias("quantity_value"))
        ing = self.ingredients.select(F.col("seq").alias("l_partkey"), "sku", F.col("pack_size_unit").alias("unit"))
        k = (F.col("l_partkey") + F.col("l_suppkey")) % 3
        archived = F.when(k == 1, F.lit(True)).when(k == 2, F.lit(False))
        created = _days(F.col("first_ship"), 1)
        by = _user(F.col("l_suppkey") % 50)
        df = g.join(ing, "l_partkey").select(
            "sku",
            F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("ingredient_batch_code"),
            F.col("first_ship").alias("received_at"),
            "quantity_value", F.col("unit").alias("quantity_unit"),
            created.alias("created_at"), created.alias("updated_at"), by.alias("created_by"), by.alias("updated_by"),
            F.lit(True).alias("is_active"),
            archived.alias("archived"),
            F.when(archived, F.col("last_ship")).alias("archived_at"),
            F.when(archived, by).alias("archived_by"))
        return evolve(df, SCHEMAS["ingredient_batches"])

    @cached_property
    def ingredient_set_items(self) -> DataFrame:
        df = self._lines_of(self._sorted_heads).select(
            "set_code", "sku", F.col("o_orderdate").alias("created_at"), "created_by")
        return evolve(df, SCHEMAS["ingredient_set_items"])

    @cached_property
    def ingredient_sets(self) -> DataFrame:
        df = self._sorted_heads.where(F.size("items") > 0).select(
            "set_code", H.hash_set(_of_items(_item_sku)).alias("set_hash"), F.col("o_orderdate").alias("created_at"),
            "created_by",
            F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("notes"),
            _pick(F.col("o_custkey") % 13, R.MATERIAL_WORKSTREAM_OPTIONS).alias("material_workstream"))
        return evolve(df, SCHEMAS["ingredient_sets"])

    @cached_property
    def dry_weight_items(self) -> DataFrame:
        df = self._lines_of(self._sorted_heads).select("set_code", "weight_code", "sku", _wt_percent(F.col("qty")).alias("wt_percent"),
                                       F.col("o_orderdate").alias("created_at"), "created_by")
        return evolve(df, SCHEMAS["dry_weight_items"])

    @cached_property
    def dry_weight_variants(self) -> DataFrame:
        items = _of_items(lambda x: F.struct(_item_sku(x).alias("sku"), _wt_percent(x["qty"]).alias("wt_percent")))
        df = self._sorted_heads.where(F.size("items") > 0).select(
            "set_code", "weight_code", H.hash_weights(items).alias("weight_hash"),
            F.col("o_orderdate").alias("created_at"), "created_by", F.col("o_orderpriority").alias("notes"))
        return evolve(df, SCHEMAS["dry_weight_variants"])

    @cached_property
    def batch_variant_items(self) -> DataFrame:
        df = self._lines_of(self._sorted_heads).select(
            "set_code", "weight_code", "batch_variant_code", "sku",
            _batch(F.col("suppkey")).alias("ingredient_batch_code"),
            F.col("o_orderdate").alias("created_at"), "created_by")
        return evolve(df, SCHEMAS["batch_variant_items"])

    @cached_property
    def batch_variants(self) -> DataFrame:
        keys = ["set_code", "weight_code", "batch_variant_code"]
        items = _of_items(lambda x: F.struct(_item_sku(x).alias("sku"), _batch(x["suppkey"]).alias("ingredient_batch_code")))
        df = self._sorted_heads.where(F.size("items") > 0).select(
            *keys, H.hash_batches(items).alias("batch_hash"), F.col("o_orderdate").alias("created_at"),
            "created_by", F.lit(None).cast("string").alias("notes"))
        return evolve(df, SCHEMAS["batch_variants"])

    @cached_property
    def location_partners(self) -> DataFrame:
        n = self.src("nation")
        df = n.select(
            C.int_to_code(F.col("n_nationkey") + 10).alias("partner_code"),
            F.col("n_name").alias("partner_name"),
            F.when(F.col("n_nationkey") % 4 != 0,
                   F.concat(F.lit("M-"), F.col("n_regionkey").cast("string"))).alias("machine_specification"),
            _days(F.lit("2023-06-01 00:00:00").cast("timestamp_ntz"), F.col("n_nationkey")).alias("created_at"),
            F.lit("admin@example.com").alias("created_by"))
        return evolve(df, SCHEMAS["location_partners"])

    def _located(self, h: DataFrame) -> DataFrame:
        partner = C.int_to_code(F.col("c_nationkey") + 10)
        pdate = TX.to_yymmdd(_days(F.col("o_orderdate"), 3))
        loc = F.concat_ws(" ", "set_code", "weight_code", "batch_variant_code", partner, pdate)
        suffix = C.int_to_code(F.col("o_orderkey") % 676)
        return h.select("*", partner.alias("partner_code"), pdate.alias("production_date"),
                        loc.alias("location_id"), suffix.alias("process_code_suffix"),
                        F.concat_ws(" ", loc, suffix).alias("processing_code"))

    @cached_property
    def _locations(self) -> DataFrame:
        return self._located(self.order_heads)

    @cached_property
    def _sorted_locations(self) -> DataFrame:
        return self._located(self._sorted_heads)

    @cached_property
    def location_codes(self) -> DataFrame:
        df = self._sorted_locations.select(
            "set_code", "weight_code", "batch_variant_code", "partner_code", "production_date", "location_id",
            _days(F.col("o_orderdate"), 1).alias("created_at"), "created_by")
        return evolve(df, SCHEMAS["location_codes"])

    @cached_property
    def compounding_how(self) -> DataFrame:
        k = F.col("o_orderkey")
        created = _days(F.col("o_orderdate"), 2)
        df = self._sorted_locations.select(
            "processing_code", F.col("location_id").alias("location_code"), "process_code_suffix",
            _pick(k % 13, R.FAILURE_MODES).alias("failure_mode"),
            F.when(k % 5 == 0, F.concat(F.lit("https://docs.google.com/d/"), k.cast("string")))
             .when(k % 5 == 1, F.concat(F.lit("http://example.com/d/"), k.cast("string"))).alias("machine_setup_url"),
            F.when(k % 7 == 0, F.concat(F.lit("https://drive.google.com/f/"), k.cast("string"))).alias("processed_data_url"),
            F.lit(None).cast("string").alias("notes"),
            created.alias("created_at"), created.alias("updated_at"), "created_by",
            F.col("created_by").alias("updated_by"),
            (F.col("o_orderstatus") != "P").alias("is_active"))
        return evolve(df, SCHEMAS["compounding_how"])

    @cached_property
    def _bags(self) -> DataFrame:
        lines = self._lines_of(self._sorted_locations).drop("partner_code")
        lines = lines.withColumn("product_type", _pick(F.col("l_partkey") % 3, R.PRODUCT_TYPES))
        code = F.concat_ws(" ", "processing_code", "product_type", C.seq4("sequence_number"))
        return lines.withColumn("pellet_bag_code", code)

    @cached_property
    def pellet_bags(self) -> DataFrame:
        o, p = F.col("l_orderkey"), F.col("l_partkey")

        def status(a, b):
            return _pick((o * a + p * b) % len(BAG_STATUS_MIX), BAG_STATUS_MIX)

        def assignee(a):
            return F.when((o + p * a) % 4 != 0, F.concat(F.lit("a"), ((o + p) % 6).cast("string"),
                                                          F.lit("@example.com")))

        df = self._bags.select(
            F.concat(F.lit("PB-"), o.cast("string"), F.lit("-"), p.cast("string")).alias("pellet_bag_id"),
            "pellet_bag_code",
            F.split("pellet_bag_code", " ").alias("pellet_bag_code_tokens"),
            F.col("processing_code").alias("compounding_how_code"),
            "product_type", "sequence_number",
            F.col("qty").alias("bag_mass_kg"),
            (F.col("qty") - F.col("n_lines") * 4).alias("remaining_mass_kg"),
            F.col("tax").alias("short_moisture_percent"),
            _pick((o + p) % 9, R.PURPOSE_OPTIONS).alias("purpose"),
            _pick(p % 3, R.REFERENCE_SAMPLE_OPTIONS).alias("reference_sample_taken"),
            status(1, 1).alias("qc_status"),
            status(1, 2).alias("long_moisture_status"),
            status(3, 1).alias("density_status"),
            status(1, 5).alias("injection_moulding_status"),
            status(7, 1).alias("film_forming_status"),
            assignee(1).alias("long_moisture_assignee_email"),
            assignee(2).alias("density_assignee_email"),
            assignee(3).alias("injection_moulding_assignee_email"),
            assignee(5).alias("film_forming_assignee_email"),
            F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("customer"),
            F.col("ship").alias("created_at"),
            _days(F.col("ship"), p % 30).alias("updated_at"),
            "created_by", F.col("created_by").alias("updated_by"),
            ((o + p) % 9 != 0).alias("is_active"))
        return evolve(df, SCHEMAS["pellet_bags"])

    @cached_property
    def pellet_bag_assignees(self) -> DataFrame:
        n = self.src("supplier").select((F.col("s_suppkey") % 8).alias("n")).distinct()
        df = n.select(F.concat(F.lit("a"), F.col("n").cast("string"), F.lit("@example.com")).alias("email"),
                      (F.col("n") != 5).alias("is_active"),
                      F.lit(T0).cast("timestamp_ntz").alias("created_at"),
                      F.lit("admin@example.com").alias("created_by"))
        return evolve(df, SCHEMAS["pellet_bag_assignees"])

    @cached_property
    def _contexts(self) -> DataFrame:
        b = self._bags.where(F.col("product_type") == "PF")
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        created = _days(F.col("ship"), 10)
        partner = C.int_to_code(o % 25 + 10)
        date = TX.to_yymmdd(created)
        ctx = F.concat_ws(" ", "pellet_bag_code", partner, date)
        proc = C.int_to_code(p % 676)
        return b.select("*", partner.alias("partner_code"), date.alias("date_yymmdd"), ctx.alias("context_code"),
                        created.alias("ctx_created"), proc.alias("process_code"),
                        F.concat_ws(" ", ctx, proc).alias("conversion1_how_code"))

    @cached_property
    def conversion1_context(self) -> DataFrame:
        df = self._contexts.select(
            "context_code", "pellet_bag_code", "partner_code",
            F.concat(F.lit("M"), (F.col("l_partkey") % 5).cast("string")).alias("machine_code"),
            "date_yymmdd", F.col("ctx_created").alias("created_at"), "created_by",
            F.col("ctx_created").alias("updated_at"), F.col("created_by").alias("updated_by"),
            ((F.col("l_orderkey") + F.col("l_partkey")) % 6 != 0).alias("is_active"))
        return evolve(df, SCHEMAS["conversion1_context"])

    @cached_property
    def conversion1_how(self) -> DataFrame:
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        df = self._contexts.select(
            "conversion1_how_code", "context_code", "process_code", F.col("process_code").alias("processing_code"),
            _pick((o + p) % 13, R.FAILURE_MODES).alias("failure_mode"),
            _days(F.col("ctx_created"), 1).alias("created_at"), "created_by",
            ((o + p) % 7 != 0).alias("is_active"))
        return evolve(df, SCHEMAS["conversion1_how"])

    @cached_property
    def conversion1_products(self) -> DataFrame:
        c = self._contexts.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("l_orderkey") % 3).cast("int"))))
        o, p, i = F.col("l_orderkey"), F.col("l_partkey"), F.col("i")
        df = c.select(
            F.concat_ws(" ", "conversion1_how_code", C.seq4(i)).alias("product_code"),
            "conversion1_how_code", C.seq4(i).alias("product_suffix"),
            _pick((o + i) % 4, R.STORAGE_LOCATION_OPTIONS).alias("storage_location"),
            F.col("qty").cast("long").alias("number_units_produced"),
            ((o + i) % 2 == 0).alias("numbered_in_order"),
            _pick((o + i) % 9, R.TENSILE_STATUS_OPTIONS).alias("tensile_rigid_status"),
            _pick((p + i) % 9, R.TENSILE_STATUS_OPTIONS).alias("tensile_films_status"),
            _pick((p + i) % 6, R.OTHER_STATUS_OPTIONS).alias("seal_strength_status"),
            _days(F.col("ctx_created"), 2).alias("created_at"), "created_by",
            ((o + p) % 5 != 0).alias("is_active"))
        return evolve(df, SCHEMAS["conversion1_products"])

    @cached_property
    def user_roles(self) -> DataFrame:
        c = self.src("customer")
        k = F.col("c_custkey")
        role = _pick(F.when(F.col("c_mktsegment") == "AUTOMOBILE", 0).when(F.col("c_mktsegment") == "BUILDING", 1)
                     .when(F.col("c_mktsegment") == "FURNITURE", 2).when(F.col("c_mktsegment") == "MACHINERY", 3)
                     .otherwise(4), ["admin", "sku_codes", "formulations", "formulations_mix", "mixing_2"])
        df = c.select(
            F.when(k < 50, _user(k)).otherwise(F.concat(F.lower(F.col("c_name")), F.lit("@example.com")))
             .alias("email"),
            F.concat(F.lit("F"), k.cast("string")).alias("first_name"),
            F.lit(None).cast("string").alias("last_name"),
            F.when(k % 5 == 0, F.concat(F.upper(role), F.lit(" "))).otherwise(role).alias("role_group"),
            (k % 7 != 0).alias("is_active"),
            F.timestamp_add("MINUTE", k, F.lit(T0).cast("timestamp_ntz")).alias("created_at"),
            F.lit("admin@example.com").alias("created_by"))
        return evolve(df, SCHEMAS["user_roles"])

    @cached_property
    def code_counters(self) -> DataFrame:
        """Counter state consistent with the projected tables: next = highest used + 1."""
        ts = F.lit(T0).cast("timestamp_ntz")
        sets = self.ingredient_sets.agg(F.max(C.code_to_int("set_code")).alias("m")).select(
            F.lit("set_code").alias("counter_name"), F.lit("").alias("scope"),
            (F.coalesce("m", F.lit(0)) + 1).alias("next_value"))
        weights = self.dry_weight_variants.groupBy("set_code").agg(F.max(C.code_to_int("weight_code")).alias("m")) \
            .select(F.lit("weight_code").alias("counter_name"), F.col("set_code").alias("scope"),
                    (F.col("m") + 1).alias("next_value"))
        variants = self.batch_variants.groupBy("set_code", "weight_code").agg(
            F.max(C.code_to_int("batch_variant_code")).alias("m")).select(
            F.lit("batch_variant_code").alias("counter_name"), F.concat_ws(" ", "set_code", "weight_code").alias("scope"),
            (F.col("m") + 1).alias("next_value"))
        partners = self.location_partners.agg(F.max(C.code_to_int("partner_code")).alias("m")).select(
            F.lit("location_partner_code").alias("counter_name"), F.lit("").alias("scope"),
            F.greatest(F.col("m") + 1, F.lit(R.PARTNER_CODE_START)).alias("next_value"))
        bags = self.pellet_bags.agg(F.max("sequence_number").alias("m")).select(
            F.lit("pellet_bag_sequence").alias("counter_name"), F.lit(BAG_SCOPE).alias("scope"),
            (F.col("m") + 1).alias("next_value"))
        seqs = self.ingredients.agg(F.max("seq").alias("m")).select(
            F.lit("ingredient_seq").alias("counter_name"), F.lit("global").alias("scope"),
            (F.col("m") + 1).alias("next_value"))
        df = sets.unionByName(weights).unionByName(variants).unionByName(partners).unionByName(bags) \
            .unionByName(seqs) \
            .withColumn("updated_at", ts)
        return evolve(df, SCHEMAS["code_counters"])

    @cached_property
    def conversion1_product_counter(self) -> DataFrame:
        df = self.conversion1_products.agg(F.max(F.col("product_suffix").cast("long")).alias("m")).select(
            F.lit("global").alias("id"), (F.col("m") + 1).alias("next_suffix"),
            F.lit(T0).cast("timestamp_ntz").alias("updated_at"))
        return evolve(df, SCHEMAS["conversion1_product_counter"])

    @cached_property
    def audit_log(self) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS["audit_log"])

    # ---- request batches for the registration jobs (M3-M14) ----------------------------
    # One request per source row; ``submitted_at`` and ``request_id`` order each batch.

    def _per_order(self, **fields) -> DataFrame:
        """One row per head that has lines, with ``_items``: (l_partkey, fields) of its order key's lines."""
        items = _of_items(lambda x: F.struct(x["l_partkey"].alias("l_partkey"), *[f(x).alias(n) for n, f in fields.items()]))
        heads = self._locations.where(F.size("items") > 0)
        return heads.withColumn("_items", F.sort_array(items)).withColumnRenamed("o_orderkey", "l_orderkey")

    @cached_property
    def req_sets(self) -> DataFrame:
        g = self._per_order(sku=_item_sku)
        return g.select(F.col("l_orderkey").alias("request_id"), _days(F.col("o_orderdate"), 30).alias("submitted_at"),
                        F.when(F.col("l_orderkey") % 50 == 0, F.array(F.col("_items")[0]["sku"]))
                        .when(F.col("l_orderkey") % 50 == 1, F.array(F.lit("0_0000_0"), F.col("_items")[0]["sku"]))
                        .otherwise(F.transform("_items", lambda x: x["sku"])).alias("skus"),
                        F.when(F.col("l_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("notes"),
                        F.lit(None).cast("string").alias("material_workstream"),
                        F.col("created_by").alias("actor"))

    @cached_property
    def req_weights(self) -> DataFrame:
        g = self._per_order(sku=_item_sku, pct=lambda x: x["qty"] * 100 / _total())
        return g.select(F.col("l_orderkey").alias("request_id"), _days(F.col("o_orderdate"), 31).alias("submitted_at"),
                        F.when(F.col("l_orderkey") % 11 == 0, "ZZ").otherwise(F.col("set_code")).alias("set_code"),
                        F.transform("_items", lambda x, i: F.struct(
                            F.when((F.col("l_orderkey") % 7 == 0) & (i == 0), "0_0000_0").otherwise(x["sku"]).alias("sku"),
                            F.when(F.col("l_orderkey") % 3 == 0, F.get("_items", F.size("_items") - 1 - i)["pct"])
                            .otherwise(x["pct"]).alias("wt_percent"))).alias("items"),
                        F.lit(None).cast("string").alias("notes"), F.col("created_by").alias("actor"))

    @cached_property
    def req_variants(self) -> DataFrame:
        g = self._per_order(sku=_item_sku, b=lambda x: _batch(x["maxsupp"]))
        return g.select(F.col("l_orderkey").alias("request_id"), _days(F.col("o_orderdate"), 32).alias("submitted_at"),
                        "set_code",
                        F.when(F.col("l_orderkey") % 9 == 0, "ZZ").otherwise(F.col("weight_code")).alias("weight_code"),
                        F.transform("_items", lambda x, i: F.struct(
                            x["sku"].alias("sku"),
                            F.when((F.col("l_orderkey") % 5 == 0) & (i == 0), "B0").otherwise(x["b"])
                            .alias("ingredient_batch_code"))).alias("items"),
                        F.col("created_by").alias("actor"))

    @cached_property
    def req_ingredients(self) -> DataFrame:
        li = self.src("lineitem").repartition("l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("first_ship"))
        p = self.src("part")
        sp = self.src("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
        j = li.join(p.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey").join(sp, "l_suppkey")
        k, s = F.col("l_partkey"), F.col("l_suppkey")
        return j.select(
            F.concat(F.lit("I"), k.cast("string"), F.lit("-"), s.cast("string")).alias("request_id"),
            F.col("first_ship").alias("submitted_at"),
            (F.col("p_size") % 10).cast("long").alias("category_code"),
            F.col("p_name").alias("trade_name_inci"),
            F.when((k + s) % 4 == 0, F.col("p_brand")).otherwise(F.col("s_name")).alias("supplier"),
            F.when(k % 3 != 0, F.col("p_type")).alias("spec_grade"),
            F.coalesce(_pick(k % 7, R.FORMAT_VALUES), F.lit("Flakes")).alias("format"),
            (F.col("p_size") + (s % 2) * 5).cast("long").alias("pack_size_value"),
            F.when(F.col("p_size") % 2 == 0, "kg").otherwise("L").alias("pack_size_unit"),
            _user(s % 50).alias("actor"))

    @cached_property
    def req_imports(self) -> DataFrame:
        p = self.src("part")
        k = F.col("p_partkey")
        cat = F.when(k % 7 == 0, F.col("p_size") % 10).otherwise((F.col("p_size") + 1) % 10)
        sku = C.format_sku(cat, k, "p_size")
        return p.select(
            F.concat(F.lit("X"), k.cast("string")).alias("request_id"),
            F.timestamp_add("MINUTE", k, F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).alias("submitted_at"),
            F.when(k % 5 == 0, F.regexp_replace(sku, "_", "")).otherwise(sku).alias("sku"),
            cat.cast("long").alias("category_code"), F.col("p_name").alias("trade_name_inci"),
            F.col("p_brand").alias("supplier"), F.when(k % 3 != 0, F.col("p_type")).alias("spec_grade"),
            F.coalesce(_pick(k % 7, R.FORMAT_VALUES), F.lit("Flakes")).alias("format"),
            F.when(k % 13 == 0, F.lit(0)).otherwise(F.col("p_size")).cast("long").alias("pack_size_value"),
            F.when(F.col("p_size") % 2 == 0, "kg").otherwise("L").alias("pack_size_unit"),
            _user(k % 50).alias("actor"))

    @cached_property
    def req_locations(self) -> DataFrame:
        h = self.order_heads
        return h.select(F.col("o_orderkey").alias("request_id"), _days(F.col("o_orderdate"), 5).alias("submitted_at"),
                        "set_code", "weight_code", "batch_variant_code",
                        C.int_to_code(F.col("o_custkey") % 40).alias("partner_code"),
                        TX.to_yymmdd(_days(F.col("o_orderdate"), 7)).alias("production_date"),
                        F.col("created_by").alias("actor"))

    @cached_property
    def req_partners(self) -> DataFrame:
        sp = self.src("supplier")
        return sp.select(F.col("s_suppkey").alias("request_id"),
                         F.timestamp_add("MINUTE", F.col("s_suppkey"), F.lit(T0).cast("timestamp_ntz")).alias("submitted_at"),
                         F.col("s_name").alias("partner_name"),
                         F.concat(F.lit("M"), F.col("s_nationkey").cast("string")).alias("machine_specification"),
                         F.lit("admin@example.com").alias("actor"))

    @cached_property
    def req_hows(self) -> DataFrame:
        l = self._locations
        k = F.col("o_orderkey")
        return l.select(k.alias("request_id"), _days(F.col("o_orderdate"), 9).alias("submitted_at"),
                        F.col("location_id").alias("location_code"),
                        F.lower(C.int_to_code(F.floor(k / 7) % 676)).alias("process_code_suffix"),
                        F.coalesce(_pick(k % 14, R.FAILURE_MODES), F.lit("Jammed")).alias("failure_mode"),
                        F.lit(None).cast("string").alias("machine_setup_url"),
                        F.lit(None).cast("string").alias("processed_data_url"),
                        F.lit(None).cast("string").alias("notes"), F.col("created_by").alias("actor"))

    @cached_property
    def req_bags(self) -> DataFrame:
        l = self._locations.where(F.size("items") > 0).withColumnRenamed("o_orderkey", "l_orderkey")
        k = F.col("l_orderkey")
        return l.select(k.alias("request_id"), _days(F.col("o_orderdate"), 12).alias("submitted_at"),
                        F.concat(F.lit(" "), F.col("processing_code")).alias("compounding_how_code"),
                        F.lower(_pick(k % 3, R.PRODUCT_TYPES)).alias("product_type"),
                        F.col("mass").alias("bag_mass_kg"),
                        (k % 5 + 1).cast("int").alias("number_of_bags"),
                        F.when(k % 29 == 0, F.lit(-5.0)).when(k % 3 == 0, F.col("mass") / 2).alias("remaining_mass_kg"),
                        _pick(k % 5, R.QC_STATUS_OPTIONS).alias("qc_status"),
                        F.when(k % 19 == 0, "Bogus").otherwise(_pick(k % 9, R.PURPOSE_OPTIONS)).alias("purpose"),
                        _pick(k % 12, BAG_STATUS_MIX).alias("density_status"),
                        F.when(k % 2 == 0, F.lit(" a1@example.com ")).alias("density_assignee_email"),
                        (k % 100 / 10).alias("short_moisture_percent"),
                        F.when(k % 4 == 0, F.lit("  ")).otherwise("first run").alias("notes"),
                        F.lit("Acme").alias("customer"), F.col("created_by").alias("actor"))

    @cached_property
    def req_contexts(self) -> DataFrame:
        c = self._contexts
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        shift = F.when((o + p) % 2 == 0, F.lit(10)).otherwise(F.lit(20))
        n = self.src("nation").select((F.col("n_nationkey") % 25).alias("_n"), "n_regionkey")
        c = c.join(n, o % 25 == F.col("_n"), "left")
        date = TX.to_yymmdd(_days(F.col("ship"), shift))
        return c.select(F.concat(F.lit("C"), o.cast("string"), F.lit("-"), p.cast("string")).alias("request_id"),
                        _days(F.col("ship"), 25).alias("submitted_at"), "pellet_bag_code", "partner_code",
                        F.concat(F.lit("M-"), F.col("n_regionkey").cast("string")).alias("machine_code"),
                        F.when(p % 37 == 0, F.lit("240230")).otherwise(date).alias("date_yymmdd"),
                        F.col("created_by").alias("actor"))

    @cached_property
    def req_conversion_hows(self) -> DataFrame:
        c = self._contexts
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        save = p % 2 == 0
        return c.select(F.concat(F.lit("H"), o.cast("string"), F.lit("-"), p.cast("string")).alias("request_id"),
                        _days(F.col("ship"), 26).alias("submitted_at"), "context_code",
                        F.lit("").alias("process_code"),
                        F.when(save, C.int_to_code((o + p) % 676)).otherwise(F.lit("")).alias("processing_code"),
                        F.when(save, "save").otherwise("generate").alias("submit_action"),
                        F.when(o % 4 == 0, F.lit(None).cast("string")).otherwise(_pick(o % 13, R.FAILURE_MODES))
                         .alias("failure_mode"),
                        F.lit(None).cast("string").alias("machine_setup_url"),
                        F.lit(None).cast("string").alias("processed_data_url"),
                        F.col("created_by").alias("actor"))

    @cached_property
    def req_products(self) -> DataFrame:
        c = self._contexts
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        return c.select(F.concat(F.lit("P"), o.cast("string"), F.lit("-"), p.cast("string")).alias("request_id"),
                        _days(F.col("ship"), 27).alias("submitted_at"), "conversion1_how_code",
                        (o % 3 + 1).cast("int").alias("number_of_records"),
                        _pick(p % 10, R.STORAGE_LOCATION_OPTIONS).alias("storage_location"),
                        _pick(o % 11, R.TENSILE_STATUS_OPTIONS).alias("tensile_rigid_status"),
                        F.when(p % 4 == 0, F.lit("Ready")).alias("tensile_films_status"),
                        F.when(p % 23 == 0, "Bogus").otherwise(_pick(p % 7, R.OTHER_STATUS_OPTIONS)).alias("solubility_status"),
                        F.when(o % 2 == 0, F.lit(" roll ")).alias("notes"), (o % 300).alias("width_mm"),
                        (o % 2 == 1).alias("numbered_in_order"), (p % 10 / 4).alias("sd_film_thickness"),
                        F.col("created_by").alias("actor"))

    # ---- change batches for the table-change jobs (R1-R12) and document manifests -------

    @cached_property
    def chg_roles(self) -> DataFrame:
        e = self.src("events")
        u, k = F.col("user_id"), F.col("event_id")
        email = (F.when(k % 10 == 0, F.concat(F.lit("new"), u.cast("string"), F.lit("@example.com")))
                 .when(k % 10 == 1, F.concat(F.lit("idp.example.com:customer#"), F.format_string("%09d", u),
                                             F.lit("@example.com")))
                 .otherwise(F.concat(F.lit("  CUSTOMER#"), F.format_string("%09d", u), F.lit("@EXAMPLE.COM "))))
        role = F.when(F.col("event_type") == "view", "formulations").when(F.col("event_type") == "click", "sku_codes") \
                .when(F.col("event_type") == "purchase", "mixing_1").when(F.col("event_type") == "error", "admin") \
                .otherwise("formulations_mix")
        role = F.when(k % 13 == 3, " Owner ").when(k % 37 == 5, F.lit(None)).otherwise(role)
        email = F.when(k % 41 == 7, "  ").otherwise(email)
        return e.select(email.alias("email"), F.concat(F.lit("N"), u.cast("string")).alias("first_name"),
                        F.col("event_type").alias("last_name"), role.alias("role_group"),
                        F.lit(None).cast("array<string>").alias("permissions"),
                        (F.col("value") > 2.0).alias("is_active"), F.lit("admin@example.com").alias("actor"),
                        F.col("ts"), k.alias("event_id"))

    @cached_property
    def chg_floors(self) -> DataFrame:
        seq = self.src("part").agg((F.max("p_partkey") + 6).alias("next_value")).select(
            F.lit("ingredient_seq").alias("counter_name"), F.lit("global").alias("scope"), "next_value")
        per_set = self.order_heads.select(
            F.lit("weight_code").alias("counter_name"), F.col("set_code").alias("scope"),
            (F.col("o_orderkey") * 7 % 676).cast("long").alias("next_value"))
        return seq.unionByName(per_set)

    @cached_property
    def chg_bags(self) -> DataFrame:
        b = self._bags.where(F.col("sequence_number") == 1)
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        bag = F.concat(F.lit("PB-"), o.cast("string"), F.lit("-"), p.cast("string"))
        first = b.select(bag.alias("pellet_bag_id"), "pellet_bag_code",
                         F.when(p % 31 == 0, F.lit(-1.0)).when(o % 2 == 0, (F.col("qty") - F.col("n_lines")) / 2)
                         .alias("remaining_mass_kg"),
                         F.when(p % 3 == 0, F.concat(F.lit("checked "), TX.to_yymmdd(F.col("ship")))).alias("notes"),
                         F.lit(None).cast("string").alias("customer"), F.lit("Planned").alias("qc_status"),
                         _user(o % 7).alias("actor"), F.col("ship").alias("submitted_at"))
        again = b.where(o % 4 == 0).select(
            bag.alias("pellet_bag_id"), "pellet_bag_code", F.lit(None).cast("double").alias("remaining_mass_kg"),
            F.when(p % 2 == 0, F.lit("second check")).alias("notes"), F.lit("Acme").alias("customer"),
            F.lit(None).cast("string").alias("qc_status"), F.lit("editor@example.com").alias("actor"),
            _days(F.col("ship"), 1).alias("submitted_at"))
        return first.unionByName(again)

    @cached_property
    def chg_products(self) -> DataFrame:
        c = self.conversion1_products.where(F.col("product_suffix") == "0000")
        return c.select("product_code", F.lit("FM Warehouse").alias("storage_location"),
                        F.lit(None).cast("string").alias("notes"), F.lit("Ready").alias("tensile_rigid_status"),
                        F.lit("admin@example.com").alias("actor"))

    @cached_property
    def chg_archive(self) -> DataFrame:
        b = self.ingredient_batches.where(F.col("archived").isNull())
        return b.select("sku", "ingredient_batch_code", (F.col("quantity_value") > 100).alias("archived"),
                        F.lit("admin@example.com").alias("actor"))

    @cached_property
    def chg_status(self) -> DataFrame:
        b = self._bags.where(F.col("sequence_number") == 2)
        o, p = F.col("l_orderkey"), F.col("l_partkey")
        cols = R.EDITABLE_STATUS_COLUMNS + ["qc_status"]
        vals = ["Recieved", "Failed", "Complete", "Planned", "Bogus", "In Progress"]
        return b.select("pellet_bag_code", _pick(o % 5, cols).alias("status_column"),
                        _pick(p % 6, vals).alias("status_value"),
                        F.when(o % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("a"), ((o + p) % 8).cast("string"),
                                                                         F.lit("@example.com"))).alias("assigned_value"),
                        _user(o % 7).alias("actor"), F.col("ship").alias("submitted_at"))

    @cached_property
    def chg_hows(self) -> DataFrame:
        h = self._locations
        k = F.col("o_orderkey")
        first = h.select("processing_code", _pick((k + 1) % 13, R.FAILURE_MODES).alias("failure_mode"),
                         F.lit(" ").alias("machine_setup_url"),
                         F.concat(F.lit("https://drive.google.com/r/"), k.cast("string")).alias("processed_data_url"),
                         F.lit("revised").alias("notes"), F.lit("admin@example.com").alias("actor"),
                         F.col("o_orderdate").alias("submitted_at"))
        again = h.where(k % 3 == 0).select(
            "processing_code", F.lit("N/A").alias("failure_mode"), F.lit(None).cast("string").alias("machine_setup_url"),
            F.lit("").alias("processed_data_url"), F.lit("revised again").alias("notes"),
            F.lit("editor@example.com").alias("actor"), _days(F.col("o_orderdate"), 1).alias("submitted_at"))
        return first.unionByName(again)

    @cached_property
    def chg_set_meta(self) -> DataFrame:
        s = self.order_heads
        first = s.select("set_code", F.upper(F.col("o_orderpriority")).alias("notes"),
                         _pick(F.col("o_custkey") % 12, R.MATERIAL_WORKSTREAM_OPTIONS).alias("material_workstream"),
                         F.lit("editor@example.com").alias("actor"), F.col("o_orderdate").alias("submitted_at"))
        again = s.where(F.col("o_custkey") % 2 == 0).select(
            "set_code", F.lit(None).cast("string").alias("notes"), F.lit(None).cast("string").alias("material_workstream"),
            F.lit("second@example.com").alias("actor"), _days(F.col("o_orderdate"), 1).alias("submitted_at"))
        return first.unionByName(again)

    @cached_property
    def doc_manifest(self) -> DataFrame:
        """Uploaded safety sheets: two uploads per ingredient (the later one wins)."""
        i = self.ingredients.select("sku", "seq", "created_at")
        n = i.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
        k = F.col("seq")
        fname = F.when(k % 9 == 0, F.concat(F.lit("photo "), F.col("n").cast("string"), F.lit(".png"))) \
                 .otherwise(F.concat(F.lit("sheet "), F.col("n").cast("string"), F.lit(".pdf")))
        n = n.withColumn("sku", F.when(k % 17 == 0, F.concat(F.lit("X"), F.col("sku"))).otherwise(F.col("sku")))
        return n.select("sku", fname.alias("filename"),
                        F.when(k % 9 == 0, "image/png").when(k % 9 == 1, "Application/PDF").otherwise("application/pdf")
                        .alias("content_type"),
                        (k * 12345 * F.col("n")).alias("size_bytes"),
                        (k % 2 == 0).alias("confirm_replace"),
                        F.timestamp_add("HOUR", F.col("n"), F.col("created_at")).alias("uploaded_at"),
                        F.concat(F.lit("msds/ingredients/"), F.col("sku"), F.lit("/"), F.col("n").cast("string"),
                                 F.lit("_"), F.translate(fname, " ", "_")).alias("object_path"),
                        F.lit("admin@example.com").alias("actor"))

    @cached_property
    def query_log(self) -> DataFrame:
        """Per-query timing log (A13): request id, elapsed ms, bytes, logged at."""
        e = self.src("events")
        return e.select(F.col("user_id").cast("string").alias("request_id"),
                        F.col("value").alias("elapsed_ms"), F.col("event_id").alias("query_id"),
                        F.col("ts").alias("logged_at"))


TABLES = list(SCHEMAS)
#: Raw bytes of lineitem and orders for each shuffle partition at most, where the session asks for fewer partitions.
PARTITION_BYTES = 4 << 20
#: Shuffled bytes that Spark may join into one task's share at most: short lines become wide rows there.
TASK_BYTES = 16 << 20
#: Stored bytes that a task reads at most: compressed order rows become many times their size when they are sorted.
SPLIT_BYTES = 32 << 20


class StoredDomain:
    """The projected tables written once as Parquet snapshots and scanned back with the
    typed reader (S1), like stored tables in a real deployment.

    Each table is materialized lazily on first use under
    ``<spark.checkpoint.dir>/domain/<code version>/<source dir name>/<table>``; a finished
    write leaves Spark's ``_SUCCESS`` marker, so later jobs (and restarted ones) reuse it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        self.spark, self.sf_dir, self.root = spark, sf_dir.rstrip("/"), root.rstrip("/")
        self._tpch = TpchDomain(spark, sf_dir, self._kept)
        self._frames: dict[str, DataFrame] = {}

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _done(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _write(self, df: DataFrame, name: str) -> None:
        conf, wanted = self.spark.conf, {}
        to_bytes = self.spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        if self._partitions() > int(conf.get("spark.sql.shuffle.partitions")):
            wanted["spark.sql.shuffle.partitions"] = self._partitions()
        for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES), ("spark.sql.files.maxPartitionBytes", SPLIT_BYTES)):
            if to_bytes(conf.get(key)) > most:
                wanted[key] = most
        was = {k: conf.get(k) for k in wanted}
        for k, v in wanted.items():
            conf.set(k, str(v))
        try:
            df.write.mode("overwrite").options(**FILE_OPTIONS).parquet(self._path(name))
        finally:
            for k, v in was.items():
                conf.set(k, v)

    def _partitions(self) -> int:
        """Shuffle partitions for the raw tables' size, so that a task's share stays the same as they grow."""
        jvm = self.spark.sparkContext._jvm
        size = 0
        for name in ("lineitem", "orders"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            size += fs.getContentSummary(path).getLength() if fs.exists(path) else 0
        return size // PARTITION_BYTES + 1

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        if not self._done(name):
            self._write(df, name)
        return self.spark.read.schema(df.schema).parquet(self._path(name))

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            if not self._done(name):
                self._write(self._tpch[name] if name in BY_SET else clustered(self._tpch[name], name), name)
            if name in SCHEMAS:
                df = read_table(self.spark, self.root, name)
            else:
                df = self.spark.read.parquet(self._path(name))
            self._frames[name] = df
        return self._frames[name]

    def __getitem__(self, name: str) -> DataFrame:
        return self.table(name)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


def _code_version() -> str:
    """Fingerprint of every module the projection is built with."""
    import hashlib
    import inspect
    from batchtrace.sources import schemas as _s
    modules = [inspect.getmodule(TpchDomain), _s, C, H, TX, R]
    return hashlib.sha1("".join(map(inspect.getsource, modules)).encode()).hexdigest()[:12]


def _source_version(spark: SparkSession, sf_dir: str) -> str:
    """Fingerprint of the source files (name, size, modification time) from the file
    system listing, so changed input data never reuses an old materialization."""
    import hashlib
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = sorted((st.getPath().getName(), st.getLen(), st.getModificationTime()) for st in fs.listStatus(path))
    return hashlib.sha1(repr(entries).encode()).hexdigest()[:10]


_STORES: dict[tuple, StoredDomain] = {}


def _fit_session(spark: SparkSession, partitions: int) -> None:
    """Raise the session's shuffle partitions to ``partitions``, and bound a scan's share of stored rows, where large
    tables need more than one task's memory else. Queries are planned after they were built, so this stays."""
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        if to_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) > SPLIT_BYTES:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))


def domain(spark: SparkSession, sf_dir: str) -> StoredDomain:
    """Domain tables for a test-data directory, materialized once per session and code
    version in the shared checkpoint folder. A session with fewer shuffle partitions than tables of that
    size need gets as many."""
    from batchtrace.session import checkpoint_dir
    sf_dir = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        name = sf_dir.strip("/").replace("/", "_")
        root = f"{checkpoint_dir(spark).rstrip('/')}/domain/{_code_version()}/{name}-{_source_version(spark, sf_dir)}"
        _STORES[key] = StoredDomain(spark, sf_dir, root)
    _fit_session(spark, _STORES[key]._partitions())
    return _STORES[key]


def projected(spark: SparkSession, sf_dir: str) -> TpchDomain:
    """The projection itself (lazy frames over the raw test tables, nothing written)."""
    return TpchDomain(spark, sf_dir)
