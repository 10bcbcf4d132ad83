"""Sources (S1, S3, S4, S6), the vectorised UDFs (UD1, UD2) and the registration stream."""

import datetime as dt
import decimal
import os
import tempfile
import unicodedata

import pytest
from pyspark.sql import functions as F

from batchtrace.functions.udfs import nfkc_casefold, round_weight_exact
from batchtrace.sources import schemas as S

T = dt.datetime(2026, 1, 1)


def test_round_weight_exact_matches_python(spark):
    xs = [1.005, 2.675, 0.125, 12.5, 33.333333, 99.995, None] + [i / 1000 for i in range(0, 3000, 7)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(round_weight_exact("x")).collect()]
    want = [None if x is None else decimal.Decimal(x).quantize(decimal.Decimal("0.01"), decimal.ROUND_HALF_UP)
            for x in xs]
    assert got == want
    assert got[:2] == [decimal.Decimal("1.00"), decimal.Decimal("2.67")]


def test_nfkc_casefold(spark):
    df = spark.createDataFrame([("Ｆｏｏ",), ("Straße",), (None,)], "s string")
    got = [r[0] for r in df.select(nfkc_casefold("s")).collect()]
    assert got == [unicodedata.normalize("NFKC", "Ｆｏｏ").casefold(), "strasse", None]


def test_append_read_and_require_schema(spark):
    root = tempfile.mkdtemp(prefix="bt-tables-")
    rows = spark.createDataFrame([("AA", "h", T)], "set_code string, set_hash string, created_at timestamp_ntz")
    S.append(rows, root, "ingredient_sets")
    S.append(rows.withColumn("set_code", F.lit("AB")), root, "ingredient_sets")
    t = S.read_table(spark, root, "ingredient_sets")
    assert sorted(r.set_code for r in t.collect()) == ["AA", "AB"]
    assert t.columns == [f.name for f in S.SCHEMAS["ingredient_sets"].fields]
    probs = S.require_schema(spark, {"ingredient_sets": rows}).collect()
    assert {(p.table_name, p.column_name) for p in probs} == {("ingredient_sets", c) for c in
                                                               ["created_by", "notes", "material_workstream"]}


def test_stream_replay_is_idempotent(spark):
    from batchtrace.session import checkpoint_dir
    from batchtrace.streaming import register_stream as ST
    from batchtrace.sources.schemas import SCHEMAS
    base = {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS}
    base["ingredients"] = spark.createDataFrame([("a",), ("b",)], "sku string")
    work = os.path.join(checkpoint_dir(spark), "stream-test")
    req = spark.createDataFrame([(1, T, ["a", "b"], None, None, "u"), (2, T, ["b"], None, None, "u")],
                                "request_id long, submitted_at timestamp_ntz, skus array<string>, notes string, "
                                "material_workstream string, actor string")
    for _ in range(2):  # the same requests arrive twice
        req.write.mode("append").parquet(f"{work}/in")
        ST.stream_register(spark, f"{work}/in", "sets", base, f"{work}/state", f"{work}/ckpt", req.schema,
                           "2026-02-01 00:00:00", files_per_trigger=1000).awaitTermination()
    out = ST.read_outcomes(spark, f"{work}/state")
    by_batch = sorted((r.batch_id, r.request_id, r.outcome, r.set_code) for r in out.collect())
    assert by_batch == [(0, "1", "created", "AB"), (0, "2", "created", "AC"),
                        (1, "1", "existing", "AB"), (1, "2", "existing", "AC")]
    state = ST.StreamState(spark, base, f"{work}/state")
    assert state["ingredient_sets"].count() == 2


def test_require_schema_reports_nulls_in_required_columns(spark):
    rows = spark.createDataFrame([("AA", None, T, None, None, None)], S.SCHEMAS["ingredient_sets"].simpleString()
                                 .replace("struct<", "").replace(">", "").replace(":", " "))
    probs = {(p.table_name, p.column_name, p.problem) for p in S.require_schema(spark, {"ingredient_sets": rows}).collect()}
    assert probs == {("ingredient_sets", "set_hash", "null_in_required_column")}


def test_stream_compaction_keeps_state(spark):
    from batchtrace.session import checkpoint_dir
    from batchtrace.streaming import register_stream as ST
    base = {n: spark.createDataFrame([], S.SCHEMAS[n]) for n in S.SCHEMAS}
    base["ingredients"] = spark.createDataFrame([("a",), ("b",), ("c",)], "sku string")
    work = os.path.join(checkpoint_dir(spark), "stream-compact-test")
    schema = "request_id long, submitted_at timestamp_ntz, skus array<string>, notes string, " \
             "material_workstream string, actor string"
    for i, skus in enumerate([["a"], ["b"], ["a", "c"]]):
        spark.createDataFrame([(i, T, skus, None, None, "u")], schema).write.mode("append").parquet(f"{work}/in")
        ST.stream_register(spark, f"{work}/in", "sets", base, f"{work}/state", f"{work}/ckpt",
                           spark.createDataFrame([], schema).schema, "2026-02-01 00:00:00", 1000).awaitTermination()
        if i == 1:
            assert ST.compact(spark, f"{work}/state", "sets") == 1
    state = ST.StreamState(spark, base, f"{work}/state")
    assert sorted(r.set_code for r in state["ingredient_sets"].collect()) == ["AB", "AC", "AD"]
    assert state["ingredient_set_items"].count() == 4


def test_append_batch_is_idempotent(spark):
    root = tempfile.mkdtemp(prefix="bt-batches-")
    rows = spark.createDataFrame([("AA", "h", T), ("AB", "h2", T)], "set_code string, set_hash string, created_at timestamp_ntz")
    S.append(rows.where("set_code = 'AA'"), root, "ingredient_sets")
    S.append_batch(rows, root, "ingredient_sets", 7)
    S.append_batch(rows, root, "ingredient_sets", 7)  # the same batch again (e.g. after a failure)
    got = sorted(r.set_code for r in S.read_table(spark, root, "ingredient_sets").collect())
    assert got == ["AA", "AA", "AB"]


def test_read_table_ignores_snapshot_dirs(spark):
    root = tempfile.mkdtemp(prefix="bt-snap-")
    rows = spark.createDataFrame([("AA", "h", T)], "set_code string, set_hash string, created_at timestamp_ntz")
    S.append(rows, root, "ingredient_sets")
    S.write_snapshot(rows.union(rows), root, "ingredient_sets", "s1")
    assert S.read_table(spark, root, "ingredient_sets").count() == 1


def test_tables_mapping_feeds_plans(spark):
    from batchtrace.plans import views as V
    root = tempfile.mkdtemp(prefix="bt-tables-map-")
    S.append(spark.createDataFrame([("AA", "AB", "AC", "h", T)], "set_code string, weight_code string, "
                                   "batch_variant_code string, batch_hash string, created_at timestamp_ntz"),
             root, "batch_variants")
    S.append(spark.createDataFrame([("AA", "AB", "AC", "s1", "B1", T)], "set_code string, weight_code string, "
                                   "batch_variant_code string, sku string, ingredient_batch_code string, "
                                   "created_at timestamp_ntz"), root, "batch_variant_items")
    for name in ("dry_weight_variants", "dry_weight_items"):
        S.append(spark.createDataFrame([], S.SCHEMAS[name]), root, name)
    t = S.Tables(spark, root)
    f = V.formulations(t).first()
    assert (f.base_code, f.sku_list, f.dry_weight_items[0].wt_percent) == ("AA AB AC", ["s1"], None)


def test_stream_batch_can_be_replayed_after_any_write(spark, monkeypatch):
    """A micro-batch that dies after any of its writes and is run again leaves the same tables."""
    from pyspark.sql import DataFrameWriter
    from batchtrace.session import checkpoint_dir
    from batchtrace.streaming import register_stream as ST
    base = {n: spark.createDataFrame([], S.SCHEMAS[n]) for n in S.SCHEMAS}
    base["ingredients"] = spark.createDataFrame([("a",), ("b",)], "sku string")
    schema = "request_id long, submitted_at timestamp_ntz, skus array<string>, notes string, " \
             "material_workstream string, actor string"
    first = spark.createDataFrame([(1, T, ["a"], "n1", None, "u")], schema)
    second = spark.createDataFrame([(2, T, ["a"], "n2", "w", "v"), (3, T, ["b"], None, None, "u"),
                                    (4, T, ["b"], "late", None, "u"), (5, T, ["zz"], None, None, "u")], schema)
    names = ["ingredient_sets", "ingredient_set_items", "code_counters"]

    def tables(state_dir):
        state = ST.StreamState(spark, base, state_dir)
        out = {n: sorted(map(str, state[n].collect())) for n in names}
        out["outcomes"] = sorted(map(str, ST.read_outcomes(spark, state_dir).collect()))
        return out

    def run(state_dir, dies_after=None):
        process = ST._process("sets", base, state_dir, "2026-02-01 00:00:00")
        process(first, 0)
        if dies_after is not None:
            write, left = DataFrameWriter.parquet, [dies_after]

            def dying(self, *a, **k):
                if not left[0]:
                    raise RuntimeError("executor lost")
                left[0] -= 1
                return write(self, *a, **k)
            with monkeypatch.context() as m:
                m.setattr(DataFrameWriter, "parquet", dying)
                with pytest.raises(RuntimeError):
                    process(second, 1)
            assert tables(state_dir)["outcomes"] != [] and len(ST.StreamState(spark, base, state_dir).committed) == 1
        process(second, 1)
        process(second, 1)  # and once more after its commit
        return tables(state_dir)

    root = os.path.join(checkpoint_dir(spark), "stream-replay")
    want = run(f"{root}/whole")
    assert len(want["ingredient_sets"]) == 2 and "notes='n2'" in want["ingredient_sets"][0]
    assert "notes='late'" in want["ingredient_sets"][1]  # a later request of the same hash keeps its notes
    for k in (0, 3, 5):
        assert run(f"{root}/dies-{k}", dies_after=k) == want


SET_REQUEST = ("request_id long, submitted_at timestamp_ntz, skus array<string>, notes string, "
               "material_workstream string, actor string")
WEIGHT_REQUEST = ("request_id long, submitted_at timestamp_ntz, set_code string, "
                  "items array<struct<sku: string, wt_percent: double>>, notes string, actor string")


def _small_base(spark):
    base = {n: spark.createDataFrame([], S.SCHEMAS[n]) for n in S.SCHEMAS}
    base["ingredients"] = spark.createDataFrame([("a",), ("b",), ("c",)], "sku string")
    return base


def test_kinds_share_one_state(spark):
    """A weight request sees the set that a stream made before it, and the next new set gets the next code."""
    from batchtrace.session import checkpoint_dir
    from batchtrace.streaming import register_stream as ST
    base, work = _small_base(spark), os.path.join(checkpoint_dir(spark), "stream-kinds")

    def feed(stream, kind, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{work}/{stream}/in")
        ST.stream_register(spark, f"{work}/{stream}/in", kind, base, f"{work}/state", f"{work}/{stream}/checkpoint",
                           spark.createDataFrame([], schema).schema, "2026-02-01 00:00:00").awaitTermination()

    feed("s1", "sets", [(1, T, ["a"], None, None, "u")], SET_REQUEST)
    feed("w", "weights", [(1, T, "AB", [("a", 100.0)], None, "u"), (2, T, "AC", [("a", 100.0)], None, "u")], WEIGHT_REQUEST)
    feed("s2", "sets", [(1, T, ["b"], None, None, "u")], SET_REQUEST)  # another stream: its first batch is 0 too
    feed("s1", "sets", [(2, T, ["c"], None, None, "u"), (3, T, ["a"], "noted", None, "u")], SET_REQUEST)
    out = {(r.kind, r.commit, r.request_id): (r.outcome, r.set_code, r.weight_code, r.rule)
           for r in ST.read_outcomes(spark, f"{work}/state").collect()}
    assert out == {("sets", 0, "1"): ("created", "AB", None, None), ("weights", 1, "1"): ("created", "AB", "AB", None),
                   ("weights", 1, "2"): ("rejected", None, None, "unknown_set"), ("sets", 2, "1"): ("created", "AC", None, None),
                   ("sets", 3, "2"): ("created", "AD", None, None), ("sets", 3, "3"): ("existing", "AB", None, None)}
    before = {n: sorted(map(str, ST.StreamState(spark, base, f"{work}/state")[n].collect()))
              for n in ("ingredient_sets", "ingredient_set_items", "dry_weight_variants", "code_counters")}
    assert ST.compact(spark, f"{work}/state") == 3 and ST.compact(spark, f"{work}/state") is None
    from batchtrace.sources.commits import remove_unused
    assert remove_unused(spark, f"{work}/state")
    state = ST.StreamState(spark, base, f"{work}/state")
    assert {n: sorted(map(str, state[n].collect())) for n in before} == before
    assert len(state.files("ingredient_sets")[1]) == 1


def test_lost_race_is_computed_again(spark):
    """A micro-batch that another stream overtakes is registered on the state which that one left."""
    from batchtrace.session import checkpoint_dir
    from batchtrace.sources import commits
    from batchtrace.streaming import register_stream as ST
    base, state_dir = _small_base(spark), os.path.join(checkpoint_dir(spark), "stream-race")
    rows = lambda i, sku: spark.createDataFrame([(i, T, [sku], None, None, "u")], SET_REQUEST)
    one = ST._process("sets", base, state_dir, "2026-02-01 00:00:00", "one")
    commit, calls = commits.TableStore.commit, []

    def overtaken(self, changes, key=None, actor=None):
        calls.append(key)
        if len(calls) == 1:
            ST._process("sets", base, state_dir, "2026-02-01 00:00:00", "two")(rows(2, "b"), 0)
        return commit(self, changes, key, actor)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(commits.TableStore, "commit", overtaken)
        one(rows(1, "a"), 0)
    assert calls == ["sets/one/0", "sets/two/0", "sets/one/0"]
    assert {(r.request_id, r.set_code) for r in ST.read_outcomes(spark, state_dir).collect()} == {("2", "AB"), ("1", "AC")}
    state = ST.StreamState(spark, base, state_dir)
    assert sorted((r.set_code) for r in state["ingredient_sets"].collect()) == ["AB", "AC"]
    assert state["code_counters"].first().next_value == 3
    assert commits.remove_unused(spark, state_dir) == []  # what the lost commit wrote is gone already


def test_change_of_two_tables_is_seen_whole_or_not_at_all(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter
    from batchtrace.sources import commits
    root = tempfile.mkdtemp(prefix="bt-change-")
    heads = spark.createDataFrame([("AA", "h", T), ("AB", "g", T)], "set_code string, set_hash string, created_at timestamp_ntz")
    items = spark.createDataFrame([("AA", "a", T), ("AB", "b", T)], "set_code string, sku string, created_at timestamp_ntz")
    S.append(heads, root, "ingredient_sets")
    S.append_batch(items, root, "ingredient_set_items", 1)

    def drop(s):
        return {n: (commits.REPLACE, s[n].where("set_code <> 'AA'")) for n in ("ingredient_sets", "ingredient_set_items")}

    def now():
        t = S.Tables(spark, root)
        return [sorted(r.set_code for r in t[n].collect()) for n in ("ingredient_sets", "ingredient_set_items")]

    write = DataFrameWriter.parquet
    for survives in (0, 1, 2):  # dies in the first table, in the second, in the commit
        left = [survives]

        def dying(self, *a, **k):
            if not left[0]:
                raise RuntimeError("executor lost")
            left[0] -= 1
            return write(self, *a, **k)
        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", dying)
            with pytest.raises(RuntimeError):
                commits.change_tables(spark, root, drop)
        assert now() == [["AA", "AB"], ["AA", "AB"]]
    old = S.Tables(spark, root)
    assert commits.change_tables(spark, root, drop) == 2
    assert now() == [["AB"], ["AB"]]
    assert sorted(r.set_code for r in old.ingredient_sets.collect()) == ["AA", "AB"]  # a reader keeps its version
    S.append_batch(items, root, "ingredient_set_items", 1)  # in the snapshot already
    assert now() == [["AB"], ["AB"]]
    S.append(heads.where("set_code = 'AA'"), root, "ingredient_sets")
    assert now() == [["AA", "AB"], ["AB"]]
    commits.remove_unused(spark, root)
    assert now() == [["AA", "AB"], ["AB"]]


def test_published_snapshot_is_read(spark):
    root = tempfile.mkdtemp(prefix="bt-publish-")
    rows = spark.createDataFrame([("AA", "h", T)], "set_code string, set_hash string, created_at timestamp_ntz")
    S.append(rows, root, "ingredient_sets")
    path = S.write_snapshot(rows.union(rows), root, "ingredient_sets", "s1")
    assert not S.publish(spark, root, {"ingredient_sets": path}, version=0)  # computed from an older version
    assert S.read_table(spark, root, "ingredient_sets").count() == 1
    assert S.publish(spark, root, {"ingredient_sets": path}, version=1)
    assert S.read_table(spark, root, "ingredient_sets").count() == 2


def test_file_problems_name_each_drifted_file(spark):
    root = tempfile.mkdtemp(prefix="bt-drift-")
    whole = spark.createDataFrame([("a@x", True, T, "u")], S.SCHEMAS["pellet_bag_assignees"])
    for part in (whole, whole.drop("created_by"), whole.withColumn("is_active", F.col("is_active").cast("string")),
                 whole.withColumn("more", F.lit(1)).drop("email")):
        part.coalesce(1).write.mode("append").parquet(f"{root}/pellet_bag_assignees")
    got = S.file_problems(spark, root, ["pellet_bag_assignees", "user_roles"]).collect()
    assert sorted((r.table_name, r.column_name or "", r.problem, r.expected, r.found) for r in got) == [
        ("pellet_bag_assignees", "created_by", "missing_column", "string", None),
        ("pellet_bag_assignees", "email", "missing_column", "string", None),
        ("pellet_bag_assignees", "is_active", "wrong_type", "boolean", "string"),
        ("pellet_bag_assignees", "more", "extra_column", None, "int"), ("user_roles", "", "missing_table", None, None)]
    files = {r.column_name: r.file for r in got if r.file}
    assert files["email"] == files["more"] != files["created_by"]


def test_ingredients_imports_and_partners_share_their_counters(spark):
    """An imported SKU raises the sequence that the next new ingredient gets; partner codes follow each other."""
    from batchtrace.session import checkpoint_dir
    from batchtrace.sources import registries as R
    from batchtrace.streaming import register_stream as ST
    base = {n: spark.createDataFrame([], S.SCHEMAS[n]) for n in S.SCHEMAS}
    state_dir = os.path.join(checkpoint_dir(spark), "stream-ingredients")
    cols = ("request_id long, submitted_at timestamp_ntz, category_code long, trade_name_inci string, supplier string, "
            "spec_grade string, format string, pack_size_value long, pack_size_unit string, actor string")
    item = lambda i, name: (i, T, 1, name, "sup", None, R.FORMAT_VALUES[0], 5, "kg", "u")
    run = lambda kind, frame, n: ST._process(kind, base, state_dir, "2026-02-01 00:00:00")(frame, n)
    run("ingredients", spark.createDataFrame([item(1, "first")], cols), 0)
    known = ST.StreamState(spark, base, state_dir)["ingredients"].first()
    assert known.seq == 1
    sku = known.sku.replace("0001", "0041")
    run("imports", spark.createDataFrame([(*item(2, "imported"), sku)], cols + ", sku string"), 0)
    run("ingredients", spark.createDataFrame([item(3, "next"), item(4, "first")], cols), 1)
    out = {r.request_id: (r.outcome, r.sku, r.rule) for r in ST.read_outcomes(spark, state_dir).collect()}
    assert out["2"] == ("created", sku, None) and out["4"] == ("rejected", None, "duplicate")
    assert out["3"][1] == known.sku.replace("0001", "0042")
    names = "request_id long, submitted_at timestamp_ntz, partner_name string, machine_specification string, actor string"
    for n in (0, 1):
        run("partners", spark.createDataFrame([(10 + n, T, f"P{n}", None, "u")], names), n)
    codes = [r.partner_code for r in ST.read_outcomes(spark, state_dir, "partners").orderBy("commit").collect()]
    assert len(set(codes)) == 2 and codes == sorted(codes)
