"""Registration jobs on literal fixtures taken from the reference's tests (FIXTURES.md §3)."""

import datetime as dt

from pyspark.sql import functions as F

from batchtrace.operators import registry as M
from batchtrace.sources.schemas import SCHEMAS

AS_OF = "2026-02-05 00:00:00"
T = dt.datetime(2026, 1, 1)


def empty(spark, name):
    return spark.createDataFrame([], SCHEMAS[name])


def state(spark, **tables):
    s = {n: empty(spark, n) for n in SCHEMAS}
    s.update(tables)
    return s


def test_first_batch_variant_gets_AA_and_blank_batch_rejected(spark):
    wv = spark.createDataFrame([("IB", "AB", "h", T, None, None)], SCHEMAS["dry_weight_variants"])
    wi = spark.createDataFrame([("IB", "AB", "0_0000_00", 50, T, None), ("IB", "AB", "9_0279_1", 50, T, None)],
                               "set_code string, weight_code string, sku string, wt_percent int, created_at timestamp_ntz,"
                               " created_by string").withColumn("wt_percent", F.col("wt_percent").cast("decimal(38,9)"))
    ib = spark.createDataFrame([("0_0000_00", "BATCH_A"), ("9_0279_1", "BATCH_B")], "sku string, ingredient_batch_code string")
    st = state(spark, dry_weight_variants=wv, dry_weight_items=wi, ingredient_batches=ib)
    req = spark.createDataFrame(
        [(1, T, "ib", "ab", [("0_0000_00", "BATCH_A"), ("9_0279_1", "BATCH_B")], "u@x"),
         (2, T, "IB", "AB", [("0_0000_00", "   "), ("9_0279_1", "BATCH_B")], "u@x")],
        "request_id long, submitted_at timestamp_ntz, set_code string, weight_code string, "
        "items array<struct<sku:string,ingredient_batch_code:string>>, actor string")
    acc, rej, new = M.register_batch_variants(req, st, AS_OF, start=0)
    assert [(r.request_id, r.batch_variant_code, r.outcome) for r in acc.collect()] == [(1, "AA", "created")]
    assert [(r.request_id, r.rule) for r in rej.collect()] == [(2, "malformed_pair")]
    assert new["batch_variant_items"].count() == 2


def test_sets_dedupe_in_batch_and_replay_is_idempotent(spark):
    ing = spark.createDataFrame([("a",), ("b",), ("c",)], "sku string")
    req = spark.createDataFrame(
        [(1, T, ["b", "a"], None, None, "u"), (2, T, ["a", "b"], "n", None, "u"), (3, T, ["c", "x"], None, None, "u")],
        "request_id long, submitted_at timestamp_ntz, skus array<string>, notes string, material_workstream string, "
        "actor string")
    st = state(spark, ingredients=ing)
    acc, rej, new = M.register_sets(req, st, AS_OF)
    got = sorted((r.request_id, r.outcome, r.set_code) for r in acc.collect())
    assert got == [(1, "created", "AB"), (2, "duplicate", "AB")]
    assert rej.first().message == "Unknown SKUs: x"
    st2 = dict(st, ingredient_sets=new["ingredient_sets"], ingredient_set_items=new["ingredient_set_items"],
               code_counters=new["code_counters"])
    acc2, _, new2 = M.register_sets(req, st2, AS_OF)
    assert {r.outcome for r in acc2.collect()} == {"existing"}
    assert new2["ingredient_sets"].count() == 0


def test_code_space_exhausted(spark):
    ing = spark.createDataFrame([("a",), ("b",)], "sku string")
    ctr = spark.createDataFrame([("set_code", "", 675, T)], SCHEMAS["code_counters"])
    req = spark.createDataFrame([(1, T, ["a"], None, None, "u"), (2, T, ["b"], None, None, "u")],
                                "request_id long, submitted_at timestamp_ntz, skus array<string>, notes string, "
                                "material_workstream string, actor string")
    acc, rej, _ = M.register_sets(req, state(spark, ingredients=ing, code_counters=ctr), AS_OF)
    assert [(r.request_id, r.set_code) for r in acc.collect()] == [(1, "ZZ")]
    assert [(r.request_id, r.rule) for r in rej.collect()] == [(2, "code_space_exhausted")]


def test_bag_code_from_counter(spark):
    how = spark.createDataFrame([("AC AB AB AM 260205 AC", "AC AB AB AM 260205", "AC", "N/A", T, T, True)],
                                "processing_code string, location_code string, process_code_suffix string, "
                                "failure_mode string, created_at timestamp_ntz, updated_at timestamp_ntz, is_active boolean")
    ctr = spark.createDataFrame([("pellet_bag_sequence", "pellet_bag:global", 12, T)], SCHEMAS["code_counters"])
    req = spark.createDataFrame([(1, T, " AC  AB AB AM 260205 AC ", "pf", 25.0, 1, None, None, None, "u")],
                                "request_id long, submitted_at timestamp_ntz, compounding_how_code string, "
                                "product_type string, bag_mass_kg double, number_of_bags int, remaining_mass_kg double, "
                                "qc_status string, purpose string, actor string")
    acc, rej, new = M.mint_bags(req, {"compounding_how": how, "code_counters": ctr}, AS_OF)
    assert [r.pellet_bag_code for r in acc.collect()] == ["AC AB AB AM 260205 AC PF 0012"]
    assert new["pellet_bags"].first().remaining_mass_kg == 25.0


def test_product_suffixes_and_status_defaults(spark):
    ctr = spark.createDataFrame([("global", 42, T)], SCHEMAS["conversion1_product_counter"])
    hows = spark.createDataFrame([("EV AB", True), ("EV AC", False)], "conversion1_how_code string, is_active boolean")
    req = spark.createDataFrame([(1, T, "EV AB", 2, None, "Ready", None, "u"), (2, T, "EV AC", 1, None, None, None, "u"),
                                 (3, T, "EV AB", 1, "Attic", None, None, "u")],
                                "request_id long, submitted_at timestamp_ntz, conversion1_how_code string, "
                                "number_of_records int, storage_location string, tensile_rigid_status string, "
                                "tensile_films_status string, actor string")
    acc, rej, new = M.mint_products(req, {"conversion1_product_counter": ctr, "conversion1_how": hows,
                                        "conversion1_products": empty(spark, "conversion1_products")}, AS_OF)
    assert sorted(r.product_code for r in acc.collect()) == ["EV AB 0042", "EV AB 0043"]
    assert {r.rule for r in rej.collect()} == {"unknown_or_inactive_how", "invalid_storage_location"}
    assert {r.tensile_films_status for r in new["conversion1_products"].collect()} == {"Ready"}
    assert new["conversion1_product_counter"].first().next_suffix == 44


def test_how_code_resolution_truth_table(spark):
    df = spark.createDataFrame([("AB", "CD", "save"), ("AB", "", "save"), ("", "CD", "save"), ("", "", "save"),
                                ("", "", "generate")], "p string, q string, a string")
    code, err = M.resolve_how_code("p", "q", "a")
    got = [(r[0], r[1] is not None) for r in df.select(code, err).collect()]
    assert got == [("CD", False), ("AB", False), ("CD", False), ("", True), ("", False)]


def test_import_in_batch_conflicts(spark):
    cols = ("request_id string, submitted_at timestamp_ntz, sku string, category_code long, trade_name_inci string, "
            "supplier string, spec_grade string, format string, pack_size_value long, pack_size_unit string, "
            "actor string")
    t1, t2, t3, t4 = (dt.datetime(2026, 1, d) for d in (1, 2, 3, 4))
    req = spark.createDataFrame([
        ("r1", t1, "1_0005_10", 0, "agar", "S", None, "Powder", 10, "kg", "u"),     # new product P, seq 5
        ("r2", t2, "1_0006_20", 0, "agar", "S", None, "Powder", 10, "kg", "u"),     # same product, other seq
        ("r3", t3, "1_0005_30", 0, "gum", "S", None, "Powder", 10, "kg", "u"),      # other product claims (1, 5)
        ("r4", t4, "1_0005_10", 0, "agar", "S", None, "Powder", 10, "kg", "u"),     # exact copy of r1
    ], cols)
    acc, rej, new = M.import_ingredients(req, state(spark), AS_OF)
    assert [(r.request_id, r.seq) for r in acc.collect()] == [("r1", 5)]
    assert sorted((r.request_id, r.rule) for r in rej.collect()) == [
        ("r2", "seq_mismatch"), ("r3", "seq_taken"), ("r4", "duplicate")]
    assert new["code_counters"].where("counter_name = 'ingredient_seq'").first().next_value == 6


def test_weights_exact_rounding_mode(spark):
    sets = spark.createDataFrame([("AB", "h", T, None, None, None)], SCHEMAS["ingredient_sets"])
    items = spark.createDataFrame([("AB", "a", T, None), ("AB", "b", T, None)], SCHEMAS["ingredient_set_items"])
    req = spark.createDataFrame([(1, T, "ab", [("a", 1.005), ("b", 98.995)], None, "u")],
                                "request_id long, submitted_at timestamp_ntz, set_code string, "
                                "items array<struct<sku:string,wt_percent:double>>, notes string, actor string")
    st = state(spark, ingredient_sets=sets, ingredient_set_items=items)
    acc_native, rej_native, _ = M.register_weights(req, st, AS_OF)
    acc_exact, rej_exact, _ = M.register_weights(req, st, AS_OF, exact_rounding=True)
    # native decimal rounding: 1.005 -> 1.01, 98.995 -> 99.00, total 100.01 -> rejected;
    # exact binary value: 1.005 -> 1.00 (1.00499...), 98.995 -> 99.00 (98.99500...45), total 100.00 -> accepted
    assert rej_native.first().rule == "weight_sum" and rej_exact.count() == 0
    assert [r.weight_code for r in acc_exact.collect()] == ["AB"]
    req2 = req.withColumn("items", F.array(F.struct(F.lit("a").alias("sku"), F.lit(2.675).alias("wt_percent")),
                                           F.struct(F.lit("b").alias("sku"), F.lit(97.33).alias("wt_percent"))))
    acc2, rej2, _ = M.register_weights(req2, st, AS_OF, exact_rounding=True)
    assert [r.weight_code for r in acc2.collect()] == ["AB"] and rej2.count() == 0
    acc3, rej3, _ = M.register_weights(req2, st, AS_OF)
    assert acc3.count() == 0 and rej3.first().rule == "weight_sum"


def test_codes_are_gap_free_per_scope(spark):
    ing = spark.createDataFrame([(f"s{i}",) for i in range(40)], "sku string")
    sets = spark.createDataFrame([(c, f"h{c}", T, None, None, None) for c in ("AA", "AB")], SCHEMAS["ingredient_sets"])
    items = spark.createDataFrame([(c, f"s{i}", T, None) for c in ("AA", "AB") for i in range(40)],
                                  SCHEMAS["ingredient_set_items"])
    ctr = spark.createDataFrame([("weight_code", "AA", 5, T)], SCHEMAS["code_counters"])
    rows = [(i, dt.datetime(2026, 1, 1 + i % 20), "AA" if i % 3 else "AB", [(f"s{i}", 60.0), (f"s{i + 1}", 40.0)],
             None, "u") for i in range(30)]
    req = spark.createDataFrame(rows, "request_id long, submitted_at timestamp_ntz, set_code string, "
                                      "items array<struct<sku:string,wt_percent:double>>, notes string, actor string")
    acc, rej, new = M.register_weights(req, state(spark, ingredients=ing, ingredient_sets=sets,
                                                  ingredient_set_items=items, code_counters=ctr), AS_OF)
    assert rej.count() == 0
    from batchtrace.functions.codes import code_to_int
    got = {}
    for r in acc.select("set_code", code_to_int("weight_code").alias("n")).collect():
        got.setdefault(r.set_code, []).append(r.n)
    assert sorted(got["AA"]) == list(range(5, 5 + len(got["AA"])))   # continues the scope's counter
    assert sorted(got["AB"]) == list(range(1, 1 + len(got["AB"])))   # no counter yet: starts at 1
    counters = {(r.counter_name, r.scope): r.next_value for r in new["code_counters"].collect()}
    assert counters[("weight_code", "AA")] == 5 + len(got["AA"])


def test_bags_need_a_remaining_mass_of_zero_or_more(spark):
    how = spark.createDataFrame([("H", True), ("H", True)], "processing_code string, is_active boolean")  # stored twice
    ctr = spark.createDataFrame([], "counter_name string, scope string, next_value long, updated_at timestamp_ntz")
    req = spark.createDataFrame([(1, T, "H", "PR", 10.0, 1, -5.0, "u"), (2, T, "H", "PR", 10.0, 2, None, "u"),
                                 (3, T, "H", "PR", 10.0, 1, 0.0, "u")],
                                "request_id long, submitted_at timestamp_ntz, compounding_how_code string, product_type string, "
                                "bag_mass_kg double, number_of_bags int, remaining_mass_kg double, actor string")
    acc, rej, new = M.mint_bags(req, {"compounding_how": how, "code_counters": ctr}, AS_OF)
    assert [(r.request_id, r.rule) for r in rej.collect()] == [(1, "invalid_remaining_mass")]
    assert sorted((r.request_id, r.sequence_number) for r in acc.collect()) == [(2, 0), (2, 1), (3, 2)]
    assert sorted(r.remaining_mass_kg for r in new["pellet_bags"].collect()) == [0.0, 10.0, 10.0]
    acc, rej, _ = M.mint_bags(req.drop("remaining_mass_kg"), {"compounding_how": how, "code_counters": ctr}, AS_OF)
    assert acc.count() == 4 and rej.count() == 0


def test_hashes_travel_as_bytes_and_only_missing_items_are_grouped(spark):
    """A content hash is shuffled as 32 bytes, and texts that are no hash stay apart from all hashes; of the
    requested items only those that fail a check reach the grouping (F13)."""
    text = "ab" * 32
    rows = spark.createDataFrame([(text,), (text.upper(),), ("x",), ("",), (None,)], "h string").select(M._hash_key(F.col("h")).alias("k"))
    keys = [r.k for r in rows.collect()]
    assert bytes(keys[0]) == bytes.fromhex(text) and keys[-1] is None
    assert len({bytes(k) for k in keys[:-1]}) == 4 and all(len(k) > 32 for k in keys[1:-1])
    named = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, None), (3, 0, "a")], "request_id long, _pos int, sku string")
    ref = spark.createDataFrame([("a",), ("a",)], "sku string")
    left = M._missing(named, ref, ["sku"], "_stored", "_inside")
    assert sorted((r.request_id, r.sku, r._stored, r._inside) for r in left.collect()) == [(1, "b", None, True), (2, None, None, True)]


def test_masked_weights_join_access_to_the_headers(spark):
    """F16: access meets the headers of the variants, and an owner with two access rows gets two rows."""
    from batchtrace.plans.catalog import masked
    t = {"batch_variants": spark.createDataFrame([("S", "A", c, "h", o) for c, o in (("A", "u"), ("B", "v"), ("C", None), ("D", "w"))],
                                                 "set_code string, weight_code string, batch_variant_code string, batch_hash string, created_by string")
         .withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz")),
         "batch_variant_items": spark.createDataFrame([("S", "A", c, "1_0001_1", "B1") for c in "ABCD"],
                                                      "set_code string, weight_code string, batch_variant_code string, sku string, ingredient_batch_code string"),
         "dry_weight_variants": spark.createDataFrame([("S", "A")], "set_code string, weight_code string"),
         "dry_weight_items": spark.createDataFrame([("S", "A", "1_0001_1", 100)], "set_code string, weight_code string, sku string, wt_percent int")}
    access = spark.createDataFrame([("u", True), ("u", False), ("v", False), ("x", True)], "email string, can_view_dry_weights boolean")
    got = masked(t, access).select("batch_variant_code", F.col("dry_weight_items").isNotNull().alias("seen")).collect()
    assert sorted((r[0], r[1]) for r in got) == [("A", False), ("A", True), ("B", False), ("C", False), ("D", False)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_codes_are_given_without_the_recipes(spark):
    st = state(spark, ingredients=spark.createDataFrame([("a",), ("b",)], "sku string"))
    req = spark.createDataFrame([(1, T, ["b", "a"], None, None, "u"), (1, T, ["x"], None, None, "u"), (2, T, ["a", "b", "b"], None, None, "u")],
                                "request_id long, submitted_at timestamp_ntz, skus array<string>, notes string, material_workstream string, actor string")
    acc, rej, new = M.register_sets(req, st, AS_OF)
    assert "skus" not in _plan(acc) and "skus" not in _plan(rej)
    # checks are reported by request id, which may come twice
    assert sorted((r.request_id, r.message) for r in rej.collect()) == [(1, "Unknown SKUs: x")] * 2
    assert sorted((r.set_code, r.sku) for r in new["ingredient_set_items"].collect()) == [("AB", "a"), ("AB", "b"), ("AB", "b")]


def test_items_outside_their_scope_are_listed_in_order(spark):
    variant = ("S", "AA", "h", T, None, None)
    wv = spark.createDataFrame([variant, variant, ("S", "AB", "h", T, None, None)], SCHEMAS["dry_weight_variants"])
    wi = spark.createDataFrame([("S", "AA", "a"), ("S", "AA", "a"), ("S", "AA", None)], "set_code string, weight_code string, sku string")
    ib = spark.createDataFrame([("a", "B"), ("b", "B"), ("c", "B")], "sku string, ingredient_batch_code string")
    items = [("c", "B"), ("a", "B"), ("b", "B"), ("c", "B")]
    req = spark.createDataFrame([(1, T, "S", "AA", items, "u"), (2, T, "S", "AB", items[:1], "u"), (3, T, "S", "ZZ", items, "u"),
                                 (4, T, "S", "AA", items[1:2], "u"), (5, T, None, "AA", items, "u")],
                                "request_id long, submitted_at timestamp_ntz, set_code string, weight_code string, "
                                "items array<struct<sku:string,ingredient_batch_code:string>>, actor string")
    acc, rej, _ = M.register_batch_variants(req, state(spark, dry_weight_variants=wv, dry_weight_items=wi, ingredient_batches=ib), AS_OF, start=0)
    assert "items" not in _plan(acc)
    assert [(r.request_id, r.batch_variant_code) for r in acc.collect()] == [(4, "AA")]
    assert {r.request_id: r.message for r in rej.collect()} == {
        1: "SKUs not in dry weight variant: c, b, c", 2: "SKUs not in dry weight variant: c",
        3: "dry weight variant does not exist", 5: "dry weight variant does not exist"}


def test_products_get_their_seq_by_row_id(spark):
    names = "sku string, category_code long, seq long, pack_size_value long, pack_size_unit string, trade_name_inci string, supplier string, spec_grade string, format string"
    ing = spark.createDataFrame([("1_0007_5", 1, 7, 5, "kg", "known", "s", None, "Powder")], names)
    rows = [(1, "known", 5), (2, "known", 6), (3, "new", 5), (4, "new", 5), (5, "new", 9), (6, "other", 5), (7, "known", 6)]
    req = spark.createDataFrame([(str(i), T + dt.timedelta(hours=i), 1, n, "s", None, "Powder", p, "kg", "u") for i, n, p in rows],
                                "request_id string, submitted_at timestamp_ntz, category_code long, trade_name_inci string, supplier string, "
                                "spec_grade string, format string, pack_size_value long, pack_size_unit string, actor string")
    acc, rej, new = M.register_ingredients(req, state(spark, ingredients=ing), AS_OF)
    assert sorted((r.request_id, r.seq, r.sku) for r in acc.collect()) == [
        ("2", 7, "1_0007_6"), ("3", 1, "1_0001_5"), ("5", 1, "1_0001_9"), ("6", 2, "1_0002_5")]
    assert sorted(r.request_id for r in rej.collect()) == ["1", "4", "7"]
    assert "trade_name_inci" not in acc._jdf.queryExecution().executedPlan().toString() and new["ingredients"].count() == 4
