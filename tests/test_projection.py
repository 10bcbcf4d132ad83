"""The domain tables shaped from raw tables: by order, without shuffles, whatever keys come twice."""

import datetime as dt
import tempfile

import pytest

from batchtrace.operators import search_index as SI
from batchtrace.plans import lineage as LN
from batchtrace.sources import tpch
from pyspark.sql import functions as F

T = dt.datetime(1998, 5, 6)


@pytest.fixture(scope="module")
def raw(spark):
    root = tempfile.mkdtemp(prefix="bt-raw-")
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_tax double, l_shipdate timestamp_ntz",
                     [(1, 4, 7, 10.0, 0.1, T), (1, 4, 6, 10.0, 0.2, T), (1, 2, 8, 20.0, 0.3, T), (2, 3, 9, 5.0, 0.1, T),
                      (3, 99, 9, 5.0, 0.1, T), (4, 2, 9, 1.0, 0.1, T), (None, 2, 9, 1.0, 0.1, T), (1, None, 9, 1.0, 0.1, T)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int",
                 [(2, "a", "b", "c", 5), (3, "a", "b", "c", 6), (3, "a", "b", "c", 7), (4, "a", "b", "c", 8), (None, "a", "b", "c", 8)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string",
                   [(1, 1, T, "O", "p"), (1, 2, T, "F", "q"), (2, 1, T, "P", "p"), (3, 1, T, "O", "p"), (5, 1, T, "O", "p"), (4, None, T, "O", "p")]),
        "customer": ("c_custkey long, c_nationkey int, c_name string, c_mktsegment string", [(1, 3, "n", "m"), (2, 4, "n", "m")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def test_order_tables_are_shaped_without_shuffles(spark, raw):
    t = tpch.TpchDomain(spark, raw, tpch.domain(spark, raw)._kept)
    names = sorted(tpch.BY_SET) + ["req_sets", "req_weights", "req_variants", "req_bags", "req_hows", "req_products", "chg_bags"]
    assert [n for n in names if "Exchange" in t[n]._jdf.queryExecution().executedPlan().toString()] == []


def test_partitions_follow_the_size_of_the_raw_tables(spark, raw, monkeypatch):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(tpch, "PARTITION_BYTES", 64)
    store = tpch.StoredDomain(spark, raw, tempfile.mkdtemp(prefix="bt-parts-"))
    assert store._partitions() > int(was)
    seen = []
    monkeypatch.setattr(type(store), "_path", lambda self, name: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or f"{self.root}/{name}")
    assert store.pellet_bags.count() == 6
    assert max(seen) == store._partitions() and spark.conf.get("spark.sql.shuffle.partitions") == was


def test_heads_and_parts_that_come_twice(spark, raw):
    t = tpch.domain(spark, raw)
    items = sorted((r.set_code, r.sku, str(r.wt_percent)) for r in t.dry_weight_items.collect())
    # order 1 has two heads, so its 40 kg count twice; part 3 has two rows; order 3 has only a line of an unknown part
    assert [(s, k, w[:5]) for s, k, w in items] == [("S1", "5_0002_5", "25.00")] * 2 + [("S1", "8_0004_8", "25.00")] * 2 + [
        ("S2", "6_0003_6", "50.00"), ("S2", "7_0003_7", "50.00")]
    assert sorted(r.set_code for r in t.ingredient_sets.collect()) == ["S1", "S1", "S2"]
    assert sorted(r.set_code for r in t.location_codes.collect()) == ["S1", "S1", "S2", "S3"]
    assert sorted((r.pellet_bag_id, r.sequence_number) for r in t.pellet_bags.collect()) == [
        ("PB-1-2", 1), ("PB-1-2", 2), ("PB-1-4", 3), ("PB-1-4", 4), ("PB-2-3", 1), ("PB-2-3", 2)]
    assert {r.request_id: [i.ingredient_batch_code for i in r["items"]] for r in t.req_variants.collect()} == {
        1: ["B8", "B8", "B7", "B7"], 2: ["B9", "B9"]}
    assert sorted((r.request_id, r.bag_mass_kg) for r in t.req_bags.collect()) == [(1, 40.0), (1, 40.0), (2, 10.0)]


def test_sku_summary_does_not_shuffle_its_result(spark, raw):
    t = tpch.domain(spark, raw)
    twice = {n: t[n].unionByName(t[n]) for n in ("pellet_bags", "compounding_how", "batch_variant_items", "batch_variants", "ingredients")}
    got = LN.sku_summary_bags(twice)
    want = LN.sku_summary_bags(t)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) == sorted(set(map(str, want.collect())))
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Join" in " ".join(plan[:2])


def test_postings_hold_a_key_once_and_are_not_shuffled(spark):
    rows = spark.range(SI.BLOCK + 10).select(F.col("id"), F.concat(F.lit("some code "), F.col("id").cast("string")).alias("code")).coalesce(1)
    posted = SI.postings(rows, "id", [F.col("code")])
    assert posted.where("gram IS NULL").agg(F.sum(F.size("keys"))).first()[0] == SI.BLOCK + 10
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    found = SI.candidates(posted, SI.gram_counts(posted), "code 4100")
    assert "4100" in [r.key for r in found.collect()]


def test_tables_are_written_in_small_splits(spark, tmp_path, monkeypatch):
    """a task that shapes a table reads a bounded share of the stored rows, however large they are."""
    from batchtrace.sources import tpch
    store = tpch.StoredDomain(spark, "/root/testdata/sf0.001", str(tmp_path))
    monkeypatch.setattr(tpch, "SPLIT_BYTES", 4096)
    spark.range(20000).repartition(1).write.parquet(f"{tmp_path}/rows")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    store._write(spark.read.parquet(f"{tmp_path}/rows"), "copy")
    assert len(list((tmp_path / "copy").glob("part-*"))) > 1
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_sku_and_percentage_texts(spark):
    """The same texts and numbers as a format string gives; for SKUs also of NULL and negative numbers."""
    from pyspark.sql import functions as F
    from batchtrace.functions import codes as C
    from batchtrace.sources import tpch
    rows = [(c, s, p) for c in (0, 9, None, -1) for s in (0, 7, 999, 1000, 12345, -3, None) for p in (1, None, -2)]
    df = spark.createDataFrame(rows, "c long, s long, p long")
    assert df.where(~C.format_sku("c", "s", "p").eqNullSafe(F.format_string("%d_%04d_%d", "c", "s", "p"))).count() == 0
    q = spark.createDataFrame([(1.0, 3.0), (50.0, 50.0), (0.0, 5.0), (7.0, 0.07)], "qty double, mass double").withColumn("n_heads", F.lit(1))
    centi = tpch._centi(F.col("qty"))
    text = F.format_string("%d.%02d", F.floor(centi / 100).cast("long"), centi % 100).cast("decimal(38,9)")
    assert q.where(~tpch._wt_percent(F.col("qty")).eqNullSafe(text)).count() == 0


def test_sessions_get_the_partitions_that_large_tables_need(spark, raw, monkeypatch):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")
    was = {k: spark.conf.get(k) for k in keys}
    try:
        tpch.domain(spark, raw)
        assert {k: spark.conf.get(k) for k in keys} == was
        monkeypatch.setattr(tpch, "PARTITION_BYTES", 64)
        n = tpch.domain(spark, raw)._partitions()
        assert [spark.conf.get(k) for k in keys] == [str(n), str(tpch.SPLIT_BYTES)] and n > int(was[keys[0]])
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_batches_are_shuffled_by_part_once(spark, raw):
    plan = tpch.TpchDomain(spark, raw).ingredient_batches._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hash" in x and "l_suppkey" in x.split("),")[0]]
