"""What is kept beside the tables: postings, metric deltas, page keys, request log, maintained view."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from batchtrace.operators import aggregates as A, filters as P, page_index as PI, paging as O
from batchtrace.operators import request_log as RL, rollups as RU, search_index as SI
from batchtrace.plans import maintained as MV, views as V
from batchtrace.sources.commits import APPEND, REPLACE, TableStore, change_tables
from batchtrace.sources.schemas import SCHEMAS

T = dt.datetime(2026, 1, 1)


@pytest.mark.parametrize("term", [None, "", "a", "ab", "abc", "ABCA", "zzz", "a b", "é_c", "abcabcab"])
def test_indexed_search_equals_the_scan(spark, term):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcAé _") for _ in range(rng.randint(0, 12))), [rng.choice(["xabc", "b", "", None, "abcabcabc"])
                                                                                     for _ in range(rng.randint(0, 3))]) for i in range(200)]
    df = spark.createDataFrame([*rows, (500, None, None)], "id long, code string, parts array<string>")
    posted = SI.postings(df, "id", [F.col("code"), F.col("parts")])
    low = (term or "").lower()
    verify = lambda d: d.where(F.contains(F.lower("code"), F.lit(low)) | F.exists("parts", lambda x: F.contains(F.lower(x), F.lit(low)))) if term else d
    got = SI.search(df, "id", posted, SI.gram_counts(posted), term, verify)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in verify(df).collect())
    if term:
        like = lambda d: P.search_like(d, ["code"], term)
        got = SI.search(df, "id", posted, SI.gram_counts(posted), term, like, like=True)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in like(df).collect())


def test_search_reads_the_rarest_grams(spark):
    df = spark.createDataFrame([(i, "common rare" if i == 7 else "common") for i in range(300)], "id long, code string")
    posted = SI.postings(df, "id", [F.col("code")])
    found = SI.candidates(posted, SI.gram_counts(posted), "common rare")
    assert [r.key for r in found.collect()] == ["7"]
    assert SI.candidates(posted, SI.gram_counts(posted), "co") is None


@pytest.mark.parametrize("spec", [[("a", True), ("k", True)], [("a", False), ("k", False)], [("a", True), ("k", False)]])
def test_any_page_equals_the_sorted_page(spark, spec):
    rows = [(None if i % 11 == 0 else i % 7, i) for i in range(137)]
    df = spark.createDataFrame(rows, "a int, k long").repartition(3)
    index = PI.build(df, spec, every=10)
    assert index.count() == 15
    for no in (1, 2, 5, 9, 13, 14, 20):
        got, total = PI.page(df, index, spec, no, 10)
        want = O.page(df, spec, no, 10)[0]
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] and total == 137
    assert [tuple(r) for r in PI.page(df, index, spec, 2, 33)[0].collect()] == [tuple(r) for r in O.page(df, spec, 2, 33)[0].collect()]
    assert PI.page(df.limit(0), PI.build(df.limit(0), spec), spec, 1)[1] == 0


def test_page_range_reaches_the_scan(spark, tmp_path):
    spark.range(5000).select(F.col("id").alias("k"), (F.col("id") / 2).cast("int").alias("a")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    spec = [("a", False), ("k", False)]
    rows, _ = PI.page(df, PI.build(df, spec, every=100), spec, 40, 50)
    assert [r.k for r in rows.collect()] == list(range(1950, 2000))
    assert "GreaterThanOrEqual(a,950)" in rows._jdf.queryExecution().toString()


def test_deltas_follow_patches_and_deletes(spark):
    bags = spark.createDataFrame([("a", 1.5, True), ("b", 2.5, True), ("c", None, True), ("d", 4.0, False), ("e", 1.0, None)],
                                 "pellet_bag_code string, bag_mass_kg double, is_active boolean")
    sets = spark.createDataFrame([("S1",), ("S1",), ("S2",)], "set_code string")
    posted = RU.deltas("pellet_bags", bags).unionByName(RU.deltas("batch_variants", sets))
    assert tuple(RU.dashboard_kpis(posted).first()) == (0, 3, 4.0)
    old = bags.where("pellet_bag_code in ('a', 'd')")
    new = old.withColumn("is_active", ~F.col("is_active"))
    posted = posted.unionByName(RU.deltas("pellet_bags", new, removed=old)).unionByName(
        RU.deltas("batch_variants", removed=sets.where("set_code = 'S2'")))
    after = bags.join(old.select("pellet_bag_code"), "pellet_bag_code", "left_anti").unionByName(new)
    ingredients = spark.createDataFrame([], SCHEMAS["ingredients"])
    assert tuple(RU.dashboard_kpis(posted).first()) == tuple(A.dashboard_kpis(ingredients, after).first()) == (0, 3, 6.5)
    assert [tuple(r) for r in RU.dependency_counts(posted).collect()] == [("S1", 2, "batch_variants")]
    assert RU.deltas("pellet_bags", new, removed=new).count() == 0
    assert tuple(RU.next_suffix(posted).first()) == (None, "AB")


def test_request_log_counts_what_ran(spark):
    root = tempfile.mkdtemp(prefix="bt-log-")
    with RL.RequestLog(spark, root, "r1") as log:
        assert log.run("all", spark.range(40), lambda d: d.where("id < 5").count()) == 5
        assert len(log.run("some", spark.range(40).where("id > 29"), lambda d: d.collect())) == 10
    with pytest.raises(ValueError), RL.RequestLog(spark, root, "r2") as log:
        log.run("bad", spark.range(3), lambda d: int("x"))
    rows = {r.name: r for r in RL.log_store(spark, root)[RL.TABLE].collect()}
    assert (rows["all"].rows, rows["some"].rows, rows["bad"].rows, rows["bad"].failed) == (40, 10, None, True)
    cost = {r.request_id: r for r in A.query_cost_rollup(RL.log_store(spark, root)[RL.TABLE]).collect()}
    assert cost["r1"].query_count == 2 and cost["r2"].query_count == 1 and cost["r1"].query_ms > 0


def test_maintained_view_equals_the_full_view(spark):
    """Random batches: variants added, items replaced, weights changed, variants deleted; then folded."""
    rng, root = random.Random(1), tempfile.mkdtemp(prefix="bt-view-")
    base = {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS}
    make = lambda s, r: MV.view_store(s, r, base)
    head = lambda keys: spark.createDataFrame([(*k, "h", T, "u", None) for k in keys], SCHEMAS["batch_variants"])
    item = lambda keys, v: spark.createDataFrame([(*k, f"s{i}", f"B{v}{i}", T, "u") for k in keys for i in range(2)], SCHEMAS["batch_variant_items"])
    keys = [(f"S{i % 4}", f"W{i % 2}", f"V{i}") for i in range(12)]

    def added(s, some):
        return ({"batch_variants": (APPEND, head(some)), "batch_variant_items": (APPEND, item(some, 0))}, {"batch_variants": head(some)})

    def weighed(s, pairs, v):
        import decimal
        rows = spark.createDataFrame([(*p, f"s{i}", decimal.Decimal(v + i), T, "u") for p in pairs for i in range(2)], SCHEMAS["dry_weight_items"])
        heads = spark.createDataFrame([(*p, "h", T, "u", None) for p in pairs], SCHEMAS["dry_weight_variants"])
        k = ["set_code", "weight_code"]
        kept = {n: s[n].join(rows.select(*k).distinct(), k, "left_anti") for n in ("dry_weight_items", "dry_weight_variants")}
        return ({"dry_weight_items": (REPLACE, kept["dry_weight_items"].unionByName(rows)),
                 "dry_weight_variants": (REPLACE, kept["dry_weight_variants"].unionByName(heads))}, {"dry_weight_items": rows})

    def gone(s, some):
        dead = head(some).select(*MV.KEYS)
        return {n: (REPLACE, s[n].join(dead, MV.KEYS, "left_anti")) for n in MV.HEADS}, {"batch_variants": dead}

    def same():
        s = make(spark, root)
        text = lambda d: sorted(str(r) for r in d.collect())
        assert text(MV.formulations(s)) == text(V.formulations(s))
        return s

    for step in (lambda s: added(s, keys[:6]), lambda s: weighed(s, [("S0", "W0"), ("S1", "W1")], 10), lambda s: added(s, keys[6:]),
                 lambda s: gone(s, rng.sample(keys, 4)), lambda s: weighed(s, [("S1", "W1"), ("S2", "W0")], 50)):
        change_tables(spark, root, MV.kept(step), make=make)
        s = same()
    updates = s[MV.TABLE].groupBy("version").count().collect()
    assert {r.version: r["count"] for r in updates}[0] == 6  # a batch adds the rows it touched
    change_tables(spark, root, MV.fold, make=make)
    assert same()[MV.TABLE].count() == 8


def test_a_large_table_is_sorted_in_bounded_shares(spark, tmp_path, monkeypatch):
    """a rewritten table's tasks take a bounded share of its stored rows, in one file or in many, and no rows are lost."""
    import pyarrow.parquet as pq
    from batchtrace.sources import schemas
    monkeypatch.setattr(schemas, "SORTED_BYTES", 64 << 10)
    monkeypatch.setitem(schemas.FILE_OPTIONS, "parquet.block.size", str(32 << 10))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = spark.range(0, 20000, 1, 1).select(F.sha2(F.col("id").cast("string"), 256).alias("set_code"), F.col("id").cast("string").alias("set_hash"))
    change_tables(spark, str(tmp_path), lambda _: {"ingredient_sets": (APPEND, rows)})
    stored = list((tmp_path / "ingredient_sets" / "_data").glob("*/part-*"))
    assert len(stored) == 1 and pq.ParquetFile(stored[0]).num_row_groups > 4  # else no task can take a part of it
    change_tables(spark, str(tmp_path), lambda s: {"ingredient_sets": (REPLACE, s.ingredient_sets)})
    new = [f for f in (tmp_path / "ingredient_sets" / "_data").glob("*/part-*") if f not in stored]
    keys = [pq.read_table(f, columns=["set_code"])["set_code"].to_pylist() for f in new]
    assert sum(map(bool, keys)) > 4 and all(k == sorted(k) for k in keys)
    assert sorted(sum(keys, [])) == sorted(r.set_code for r in rows.collect())
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_rows_of_one_scope_are_not_shuffled_to_its_counter(spark):
    """all rows have the same counter, which comes to them, however many counters of other scopes there are."""
    from batchtrace.operators import registry as M
    counters = spark.createDataFrame([("n", "all", 7, T), ("n", "other", 70, T), ("m", "all", 700, T)], SCHEMAS["code_counters"])
    req = spark.createDataFrame([(i, T, i % 3 + 1) for i in range(20)], "request_id long, submitted_at timestamp, k int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, floors = M.assign_ranges(req, "all", "k", counters, "n", 0)
        assert "SortMergeJoin" not in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(_scope" not in plan
        assert sorted(r.value for r in rows.collect()) == list(range(7, 7 + 39))
        assert [tuple(r) for r in floors.collect()] == [("n", "all", 7 + 39)]
        sets, _ = M.assign_scoped(req, [], counters, "n", 1)
        assert "SortMergeJoin" not in sets._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.value for r in sets.collect()) == list(range(1, 21))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_view_rows_that_are_the_only_ones_are_not_shuffled(spark):
    rows = spark.createDataFrame([("S", "A", str(i), 0, False) for i in range(40)] + [("S", "A", "7", 2, False), ("S", "A", "7", 1, True), ("S", "A", "9", 0, False)],
                                 "set_code string, weight_code string, batch_variant_code string, version long, gone boolean")
    got = MV._newest(rows)
    assert got.count() == 40 and [(r.version, r.gone) for r in got.where("batch_variant_code = '7'").collect()] == [(2, False)]
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
