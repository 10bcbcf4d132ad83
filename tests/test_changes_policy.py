"""Table changes (R*) and access policy (X*)."""

import datetime as dt

from pyspark.sql import functions as F

from batchtrace.operators import changes as CH, policy as X
from batchtrace.sources.schemas import SCHEMAS

T = dt.datetime(2026, 1, 1)


def test_upsert_roles_normalises_and_counts(spark):
    target = spark.createDataFrame([("a@x.com", None, None, "formulations", None, True, T, "root", None, None)],
                                   SCHEMAS["user_roles"])
    changes = spark.createDataFrame(
        [(" A@X.com ", "Ann", None, "mixing_1", None, True, "admin", 2), ("new@x.com", "N", None, "sku_codes", None,
                                                                         True, "admin", 1)],
        "email string, first_name string, last_name string, role_group string, permissions array<string>, "
        "is_active boolean, actor string, seq long")
    new, counts = CH.upsert_roles(target, changes, "2026-02-01 00:00:00", ["seq"])
    rows = {r.email: r for r in new.collect()}
    assert rows["a@x.com"].role_group == "mixing_1" and rows["a@x.com"].created_by == "root"
    assert rows["new@x.com"].created_by == "admin"
    assert tuple(counts.first()) == (1, 1)


def test_keep_null_patch(spark):
    t = spark.createDataFrame([("k1", 5.0, "n"), ("k2", 6.0, "m")], "k string, v double, notes string") \
        .withColumn("updated_at", F.lit(T)).withColumn("updated_by", F.lit("x"))
    ch = spark.createDataFrame([("k1", None, "new", "me")], "k string, v double, notes string, actor string")
    new, counts = CH.patch_keep_null(t, ch, ["k"], ["v", "notes"], "2026-02-01 00:00:00")
    got = {r.k: (r.v, r.notes, r.updated_by) for r in new.collect()}
    assert got == {"k1": (5.0, "new", "me"), "k2": (6.0, "m", "x")}
    assert counts.first().updated == 1


def test_status_update_only_mapped_pair(spark):
    from batchtrace.sources.tpch import projected
    bags = spark.createDataFrame([], SCHEMAS["pellet_bags"])
    row = {f.name: None for f in SCHEMAS["pellet_bags"].fields}
    row.update(pellet_bag_id="1", pellet_bag_code="B1", compounding_how_code="H", product_type="PF",
               sequence_number=1, bag_mass_kg=1.0, remaining_mass_kg=1.0, created_at=T, updated_at=T, is_active=True,
               density_status="Planned")
    bags = spark.createDataFrame([tuple(row[f.name] for f in SCHEMAS["pellet_bags"].fields)], SCHEMAS["pellet_bags"])
    assignees = spark.createDataFrame([("a@x", True, T, None)], SCHEMAS["pellet_bag_assignees"])
    ch = spark.createDataFrame([("B1", "long_moisture_status", "Recieved", "a@x", "me", T),
                                ("B1", "qc_status", "Requested", "", "me", T)],
                               "pellet_bag_code string, status_column string, status_value string, "
                               "assigned_value string, actor string, submitted_at timestamp_ntz")
    new, rej, _ = CH.update_status(bags, ch, assignees, "2026-02-01 00:00:00", ["submitted_at"])
    r = new.first()
    assert (r.long_moisture_status, r.long_moisture_assignee_email, r.density_status) == ("Received", "a@x", "Planned")
    assert [x.reason for x in rej.collect()] == ["invalid_status_column"]


def test_delete_sets_blocked_by_dependants(spark):
    sets = spark.createDataFrame([("AA", "h", T, None, None, None), ("AB", "h2", T, None, None, None)],
                                 SCHEMAS["ingredient_sets"])
    items = spark.createDataFrame([("AA", "s", T, None), ("AB", "s", T, None)], SCHEMAS["ingredient_set_items"])
    deps = spark.createDataFrame([("AA", 2, "dry_weight_variants")], "set_code string, n long, source string")
    codes = spark.createDataFrame([("AA",), ("AB",)], "set_code string")
    s, i, blocked = CH.delete_sets(sets, items, codes, deps)
    assert [r.set_code for r in s.collect()] == ["AA"] and i.count() == 1
    assert blocked.first().reason == "dry_weight_variants=2"


def test_effective_access_and_bootstrap(spark):
    roles = spark.createDataFrame([("a@x", None, None, "Formulations ", None, True, T, None, None, None)],
                                  SCHEMAS["user_roles"])
    users = spark.createDataFrame([("idp:A@X",), ("b@x",)], "email string")
    got = {r.email: r for r in X.effective_access(spark, users, roles).collect()}
    assert got["a@x"].can_view_dry_weights and not got["a@x"].is_admin
    assert got["b@x"].permissions == [] and not got["b@x"].can_view_dry_weights
    none_active = roles.withColumn("is_active", F.lit(False))
    boot = {r.email: r for r in X.effective_access(spark, users, none_active).collect()}
    assert boot["b@x"].is_admin and boot["b@x"].is_bootstrap_admin


def test_union_permissions_and_role_table(spark):
    from batchtrace.sources import registries as R
    df = spark.createDataFrame([(["b", "a"], ["a", "c"]), (None, ["x"])], "p array<string>, q array<string>")
    got = [r[0] for r in df.select(X.union_permissions("p", "q")).collect()]
    assert got == [["a", "b", "c"], ["x"]]
    roles = {r.role_group: r.n for r in X.role_permissions(spark).groupBy("role_group").count()
             .withColumnRenamed("count", "n").collect()}
    assert roles["admin"] == 24 and roles["formulations_mix"] == len(set(R.FORMULATIONS_PERMISSIONS)) + 6


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([("a@x.com", None, None, "formulations", None, True, T, "root", None, None)],
                                   SCHEMAS["user_roles"])
    changes = spark.createDataFrame(
        [("A@X.com", "Ann", None, "mixing_1", None, True, "admin", 1), ("b@x.com", "B", None, "admin", None, True,
                                                                      "admin", 2)],
        "email string, first_name string, last_name string, role_group string, permissions array<string>, "
        "is_active boolean, actor string, seq long")
    once, _ = CH.upsert_roles(target, changes, "2026-02-01 00:00:00", ["seq"])
    twice, counts = CH.upsert_roles(once, changes, "2026-02-01 00:00:00", ["seq"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert tuple(counts.first()) == (2, 0)


def test_unknown_roles_and_missing_emails_are_refused(spark):
    target = spark.createDataFrame([], SCHEMAS["user_roles"])
    changes = spark.createDataFrame(
        [(" ", "a", "admin", True, "u", 1), (None, "a", "admin", True, "u", 2), ("b@x", "b", "owner", True, "u", 3),
         ("b@x", "b", None, True, "u", 4), ("c@x", "c", " ADMIN ", True, "u", 5), ("c@x", "c", "owner", True, "u", 6)],
        "email string, first_name string, role_group string, is_active boolean, actor string, seq long") \
        .withColumn("last_name", F.lit(None).cast("string"))
    new, counts = CH.upsert_roles(target, changes, "2026-02-01 00:00:00", ["seq"])
    assert [(r.email, r.role_group, len(r.permissions) > 0) for r in new.collect()] == [("c@x", "admin", True)]
    assert tuple(counts.first()) == (0, 1)
    assert sorted((r.seq, r.reason) for r in CH.role_rejects(changes).collect()) == [
        (1, "email_required"), (2, "email_required"), (3, "invalid_role_group"), (4, "invalid_role_group"), (6, "invalid_role_group")]


def test_bag_patch_refuses_negative_mass(spark):
    bags = spark.createDataFrame([("p", 5.0, True), ("q", 6.0, True)], "pellet_bag_id string, remaining_mass_kg double, is_active boolean") \
        .withColumn("updated_at", F.lit(T)).withColumn("updated_by", F.lit("x"))
    changes = spark.createDataFrame([("p", -1.0, "u"), ("q", 0.0, "u")], "pellet_bag_id string, remaining_mass_kg double, actor string")
    new, rejects, counts = CH.patch_bags(bags, changes, "2026-02-01 00:00:00", ["pellet_bag_id"])
    assert {r.pellet_bag_id: r.remaining_mass_kg for r in new.collect()} == {"p": 5.0, "q": 0.0}
    assert [r.pellet_bag_id for r in rejects.collect()] == ["p"] and counts.first().updated == 1


def test_spec_sheet_does_not_stamp_the_actor(spark):
    b = spark.createDataFrame([("s", "B1", T, T, "old")], "sku string, ingredient_batch_code string, created_at timestamp_ntz, "
                              "updated_at timestamp_ntz, updated_by string")
    b = b.withColumn("spec_object_path", F.lit(None).cast("string")).withColumn("spec_uploaded_at", F.lit(None).cast("timestamp_ntz"))
    up = spark.createDataFrame([("s", "B1", "p1", T, "me"), ("s", "B1", "p2", T + dt.timedelta(1), "me")],
                               "sku string, ingredient_batch_code string, object_path string, uploaded_at timestamp_ntz, actor string")
    row = CH.set_document(b, up, ["sku", "ingredient_batch_code"], "spec", "2026-02-01 00:00:00")[0].first()
    assert (row.spec_object_path, row.updated_by) == ("p2", "old") and row.updated_at == dt.datetime(2026, 2, 1)


def test_only_rows_that_may_change_are_shuffled(spark):
    bags = spark.createDataFrame([(f"b{i % 30}", float(i), i % 7 > 0) for i in range(60)] + [(None, 1.0, True)], "k string, v double, is_active boolean")
    changes = spark.createDataFrame([("b1", 100.0, 1), ("b1", None, 2), (None, 7.0, 1), ("b9", 5.0, 1), ("zz", 5.0, 1)], "k string, v double, submitted_at long")
    new, counts = CH.patch_keep_null(bags, changes, ["k"], ["v"], None)
    want = [(k, {"b1": 100.0, "b9": 5.0}.get(k, v) if a else v, a) for k, v, a in map(tuple, bags.collect())]
    assert sorted(map(str, map(tuple, new.collect()))) == sorted(map(str, want)) and counts.first().updated == sum(a and k in ("b1", "b9") for k, _, a in want)
    assert "Union" in new._jdf.queryExecution().optimizedPlan().toString()


def test_sets_to_be_deleted_are_found_once(spark):
    sets = spark.createDataFrame([(f"S{i}",) for i in range(20)] + [(None,), ("S1",)], "set_code string")
    deps = spark.createDataFrame([("S2", "weights", 1), ("S3", "weights", 0)], "set_code string, source string, n long")
    kept, items, _ = CH.delete_sets(sets, sets, spark.createDataFrame([("S1",), ("S2",), ("S3",), (None,)], "set_code string"), deps)
    want = sorted(str(f"S{i}") for i in range(20) if i not in (1, 3)) + ["None"]
    assert sorted(str(r.set_code) for r in kept.collect()) == sorted(want) == sorted(str(r.set_code) for r in items.collect())
    assert "Union" in kept._jdf.queryExecution().optimizedPlan().toString()
