"""Operators: numbering, first-per-key, joins, quality rules (survey J*, O*, Q*)."""

from pyspark.sql import Window, functions as F

from batchtrace.operators import joins as J, paging as O, quality as Q
from batchtrace.operators.numbering import sequence_within


def test_sequence_within_matches_row_number_with_hot_scope(spark):
    df = spark.range(0, 5000).select(F.col("id").alias("rid"), (F.col("id") % 7 == 0).cast("string").alias("scope"),
                                     (F.col("id") * 7919 % 1000).alias("o"))
    a = sequence_within(df, ["scope"], ["o", "rid"])
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("scope").orderBy("o", "rid")) - 1)
    assert a.join(b, "rid").where(F.col("_seq0") != F.col("rn")).count() == 0


def test_sequence_within_weighted_global(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("rid"), (F.col("id") % 5 + 1).alias("w"))
    a = sequence_within(df, [], ["rid"], weight="w")
    b = df.withColumn("rn", F.sum("w").over(Window.orderBy("rid")) - F.col("w"))
    assert a.join(b, "rid").where(F.col("_seq0") != F.col("rn")).count() == 0


def test_first_per_key_both_paths(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, v long, p string")
    assert sorted(tuple(r) for r in O.first_per_key(df, ["k"], [("v", True)]).collect()) == [("a", 3, "y"), ("b", 2, "z")]
    mixed = O.first_per_key(df, ["k"], [("v", False), ("p", True)])
    assert sorted(tuple(r) for r in mixed.collect()) == [("a", 1, "x"), ("b", 2, "z")]


def test_page_and_keyset(spark):
    df = spark.range(0, 120).select(F.col("id").alias("n"))
    rows, total = O.page(df, [("n", True)], 2, 50)
    assert [r.n for r in rows.collect()] == list(range(69, 19, -1))
    assert total.first().total == 120
    nxt = O.page_after(df, [("n", True)], {"n": 70}, 50)
    assert [r.n for r in nxt.collect()] == list(range(69, 19, -1))
    assert O.clamp_page(0, 1000) == (1, 200) and O.clamp_page(None, None) == (1, 50)


def test_existing_batches_pairs(spark):
    asked = spark.createDataFrame([("0_0000_00", "BATCH_A"), ("9_0279_1", "BATCH_B"), ("x", "   ")],
                                  "sku string, ingredient_batch_code string")
    stored = spark.createDataFrame([("0_0000_00", "BATCH_A"), ("0_0000_00", "OTHER")],
                                   "sku string, ingredient_batch_code string")
    found, bad = J.existing_batches(asked, stored)
    assert [tuple(r) for r in found.collect()] == [("0_0000_00", "BATCH_A")]
    assert bad.count() == 1


def test_weight_sum_rules(spark):
    df = spark.createDataFrame([([("a", "10"), ("b", "10"), ("c", "80")],), ([("a", "10"), ("b", "10"), ("c", "10")],)],
                               "items array<struct<sku:string,wt_percent:string>>")
    df = df.withColumn("items", F.transform("items", lambda x: F.struct(
        x["sku"].alias("sku"), x["wt_percent"].cast("decimal(9,2)").alias("wt_percent"))))
    got = [(r[0], r[1], r[2]) for r in df.select(Q.weight_total("items"), Q.weight_sum_close("items"),
                                                 Q.weight_sum_is_100("items")).collect()]
    assert got == [(100.0, True, True), (30.0, False, False)]


def test_enum_rules(spark):
    df = spark.createDataFrame([(1, "Failed", "Failed", "Unknown")],
                               "id long, long_moisture_status string, injection_moulding_status string, s string")
    from batchtrace.sources import registries as R
    rej = Q.check_enums(df, ["id"], {"long_moisture_status": R.STATUS_VOCAB["long_moisture_status"],
                                     "injection_moulding_status": R.STATUS_VOCAB["injection_moulding_status"],
                                     "s": R.STORAGE_LOCATION_OPTIONS})
    assert sorted(r.column for r in rej.collect()) == ["long_moisture_status", "s"]


def test_membership_message_in_request_order(spark):
    req = spark.createDataFrame([(1, ["z", "a", "y", "z"])], "request_id long, skus array<string>")
    ref = spark.createDataFrame([("a",)], "sku string")
    msg = Q.check_membership(req, "skus", ref, "sku", "Unknown SKUs: ").first().message
    assert msg == "Unknown SKUs: z, y, z"


def test_skew_safe_left_join_equals_left_join(spark):
    left = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "k string, a long")
    right = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("k"),
                                        F.col("id").alias("b"))
    a = J.skew_safe_left_join(left, right, ["k"]).select("k", "a", "b")
    b = left.join(right, "k", "left").select("k", "a", "b")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_where_in_and_lookup(spark):
    from batchtrace.operators import filters as P
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v long")
    vals = spark.createDataFrame([("a",), ("c",), ("c",)], "x string")
    assert sorted(r.k for r in P.where_in(df, "k", vals, "x").collect()) == ["a", "c"]
    keys = spark.createDataFrame([("b",)], "k string")
    assert [r.v for r in P.lookup(df, keys, ["k"]).collect()] == [2]


def test_find_duplicates_null_safe(spark):
    from batchtrace.operators import filters as P
    cols = "category_code long, trade_name_inci string, supplier string, spec_grade string, format string, " \
           "pack_size_unit string, pack_size_value long"
    new = spark.createDataFrame([(1, "agar", "S", None, "Powder", "kg", 5), (1, "agar", "S", "X", "Powder", "kg", 5)], cols)
    existing = spark.createDataFrame([(1, "agar", "S", None, "Powder", "kg", 5, "1_0007_5", 7)],
                                     cols + ", sku string, seq long")
    hits = P.find_duplicates(new, existing, P.duplicate_keys()).collect()
    assert [(h.spec_grade, h.sku) for h in hits] == [(None, "1_0007_5")]


def test_sku_matrix_dense_and_sparse(spark):
    from batchtrace.operators import aggregates as A
    v = spark.createDataFrame([("S", "W1", [("a", "10"), ("b", "90")]), ("S", "W2", [("b", "40"), ("c", "60")])],
                              "set_code string, weight_code string, items array<struct<sku:string,wt_percent:string>>")
    dense = {r.weight_code: (r.columns, r.cells) for r in
             A.sku_matrix(v, ["set_code", "weight_code"], "wt_percent", ["set_code"]).collect()}
    assert dense["W1"] == (["a", "b", "c"], ["10", "90", None])
    assert dense["W2"] == (["a", "b", "c"], [None, "40", "60"])
    sparse = {r.weight_code: (r.n_columns, [(c.col, c.value) for c in r.cells]) for r in
              A.sku_matrix_sparse(v, ["set_code", "weight_code"], "wt_percent", ["set_code"]).collect()}
    assert sparse == {"W1": (3, [(0, "10"), (1, "90")]), "W2": (3, [(1, "40"), (2, "60")])}


def test_setops(spark):
    from batchtrace.operators import setops as U
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    b = spark.createDataFrame([("y", 9), ("y", 8)], "k string, w long")
    assert [r.k for r in U.common(a, b, ["k"]).collect()] == ["y"]
    u = U.union_labelled({"A": a, "B": a.where("k = 'x'")})
    assert sorted((r.k, r.source) for r in u.collect()) == [("x", "A"), ("x", "B"), ("y", "A")]
    req = spark.createDataFrame([(1, ["q", "x", "q"])], "request_id long, vals array<string>")
    assert U.unknown(req, "vals", a, "k", "Unknown: ").first().message == "Unknown: q, q"


def test_check_unique_reports_repeated_keys(spark):
    from batchtrace.operators import quality as Q
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    got = Q.check_unique(df, ["k", "v"], "t").collect()
    assert [(r.k, r.v, r.n, r.rule) for r in got] == [("a", 1, 2, "duplicate_key")]


def test_weights_and_variants_of_one_parent(spark):
    from batchtrace.plans import lineage as LN
    from batchtrace.sources.tpch import domain
    t = domain(spark, "/root/testdata/sf0.001")
    head = t.batch_variants.orderBy("set_code").first()
    w = LN.weights_of_set(t, head.set_code).collect()
    v = LN.variants_of_weight(t, head.set_code, head.weight_code).collect()
    assert [r.weight_code for r in w] == [head.weight_code] and [r.batch_variant_code for r in v] == [head.batch_variant_code]
    sku = v[0]["items"][0].sku
    codes = [r.ingredient_batch_code for r in LN.batches_of_sku(t, sku, include_archived=True).collect()]
    assert codes and codes == sorted(codes)
    assert LN.sku_summary_ingredient(t, spark.createDataFrame([(sku.lower(),)], "sku string")).first().sku == sku


def test_first_ids_equal_the_first_rows(spark):
    """Times with equal microseconds, numbers at both ends of a long, and nulls keep their order."""
    import datetime as dt
    at = [dt.datetime(2026, 1, 1, 0, 0, 0, i) for i in (0, 1, 1, 2)] + [None]
    ids = [(1 << 63) - 1, -(1 << 63), 0, 7, 3, None]
    rows = [(k % 3, at[k % 5], ids[k % 6], k) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, submitted_at timestamp_ntz, request_id long, _rid long")
    want = {}
    for k, a, i, r in rows:
        o = (a is not None, a or at[0], i if i is not None else -(1 << 63))
        if k not in want or o < want[k][0]:
            want[k] = (o, r)
    got = O.first_ids(df, ["k"], ["submitted_at", "request_id"])
    plan = got._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    by = {r._rid: r for r in df.collect()}
    for r in got.collect():
        first = by[r._first_rid]
        assert (first.submitted_at is not None, first.submitted_at or at[0], first.request_id if first.request_id is not None else -(1 << 63)) == want[r.k][0]
    text = df.withColumn("request_id", F.col("request_id").cast("string"))  # no fixed width: a struct
    assert O.first_ids(text, ["k"], ["submitted_at", "request_id"]).count() == 3


def test_numbering_moves_the_rows_once(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") % 3 == 0, "cold").when(F.col("id") % 50 == 1, F.lit(None).cast("string")).otherwise("hot")) \
        .withColumn("w", F.col("id") % 4)
    out = sequence_within(df, ["s"], ["id"], weight="w", num_partitions=7)
    assert "Exchange hashpartitioning" not in out._jdf.queryExecution().toString()
    came = {}
    for r in sorted(out.collect(), key=lambda r: r.id):
        assert r._seq0 == came.get(r.s, 0)
        came[r.s] = came.get(r.s, 0) + r.w
    assert sequence_within(df.limit(0), ["s"], ["id"]).count() == 0


def test_pinned_rows_are_tables_of_which_columns_are_read(spark):
    from batchtrace.session import pin
    got = pin(spark.range(5).select("id", F.struct(F.lit(1).alias("a")).alias("s"), F.lit("x").alias("wide")))
    plan = got.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and got.where("id > 2 and s.a = 1").count() == 2
    assert pin(spark.range(3).select("id", F.lit(None).alias("nothing"))).count() == 3  # Parquet has no such type


def test_only_rows_whose_key_is_named_are_shuffled(spark):
    from batchtrace.operators import joins as J
    rows = spark.range(200).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("k"), "id")
    named = spark.createDataFrame([("k1",), ("k1",), (None,), ("k77",), ("none",)], "k string")
    near, far = J.split_by_keys(rows, named, ["k"])
    assert near.count() + far.count() == 200 and far.count() > 180
    assert far.where(F.col("k").isin("k1", "k77")).count() == 0
    for got, how in ((J.semi_join(rows, named, ["k"]), "left_semi"), (J.anti_join(rows, named, ["k"]), "left_anti")):
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in rows.join(named, "k", how).collect())
    # equal keys of two types have other hashes: nothing is told apart
    assert J.split_by_keys(spark.range(3), spark.range(3).select(F.col("id").cast("int").alias("id")), ["id"])[1] is None


def test_bags_of_a_sku_are_shuffled_once(spark):
    from batchtrace.plans import lineage as LN
    form, at = "set_code string, weight_code string, batch_variant_code string", "2026-01-01"
    t = {"batch_variants": spark.createDataFrame([("S", "A", "A"), ("S", "A", "B")], form).withColumn("created_at", F.lit(at)),
         "batch_variant_items": spark.createDataFrame([("S", "A", "A", "x"), ("S", "A", "A", "X"), ("S", "A", "B", "x"), ("S", "A", "C", "x"), ("S", "A", "B", "y")],
                                                      form + ", sku string"),
         "ingredients": spark.createDataFrame([("X",), ("X",), ("y",)], "sku string"),
         "compounding_how": spark.createDataFrame([("h1", "S A A P 1"), ("h1", "S A B P 1"), ("h1", "S A B P 2"), ("h2", "S A"), (None, "S A A")],
                                                  "processing_code string, location_code string"),
         "pellet_bags": spark.createDataFrame([("1", "b1", "h1", True), ("1", "b1", "h1", True), ("2", "b2", "h1", False), ("3", "b3", "h2", True), ("4", "b4", None, True)],
                                              "pellet_bag_id string, pellet_bag_code string, compounding_how_code string, is_active boolean")
         .withColumn("updated_at", F.lit(at)).withColumn("created_at", F.lit(at))}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = LN.sku_summary_bags(t)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.requested_sku, r.pellet_bag_id) for r in out.collect()) == [("X", "1"), ("y", "1")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sum("Exchange hash" in line and "pellet_bag_id" not in line and "compounding_how_code" in line for line in plan.splitlines()) == 2
    assert plan.count("Exchange hash") <= 8
