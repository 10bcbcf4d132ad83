"""Table changes (R1-R12) re-aimed as snapshot rewrites: ``new = f(target, changes)``.

Parquet has no UPDATE/MERGE/DELETE; each function returns the complete new table frame
(written by ``sources.schemas.write_snapshot``) plus a counts frame mirroring the
affected-row counts of the DML it replaces. All are joins on the table key, so a change
batch of any size costs one shuffle of target and changes; the clock is ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from batchtrace.functions.text import blank_to_null, repair_status
from batchtrace.operators import paging as O
from batchtrace.operators.joins import anti_join, split_by_keys
from batchtrace.session import pin
from batchtrace.sources import registries as R


def _ts(as_of) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _counts(**named: Column) -> list[Column]:
    return [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in named.items()]


def _with_counts(df: DataFrame, **named: Column) -> DataFrame:
    return df.agg(*_counts(**named))


def _role_reason() -> Column:
    """First failed check of a role change, else NULL."""
    return (F.when(blank_to_null("email").isNull(), F.lit("email_required"))
            .when(~F.coalesce(F.lower(F.trim("role_group")).isin(*R.ROLE_GROUPS), F.lit(False)), F.lit("invalid_role_group")))


def role_rejects(changes: DataFrame) -> DataFrame:
    """The role changes that ``upsert_roles`` refuses, with the reason: an email and a known role
    are required."""
    return changes.withColumn("reason", _role_reason()).where("reason IS NOT NULL")


def upsert_roles(target: DataFrame, changes: DataFrame, as_of, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """MERGE by lower-cased email. Matched rows get the new names, role, permissions and
    active flag plus update stamps (email and created_* kept); unmatched changes are
    inserted. Emails and roles are trimmed and lower-cased, blank names become NULL, and the
    permissions are those of the role. Changes without an email or with an unknown role are left
    out (``role_rejects``). The batch is then reduced to its last change per email (``order``)."""
    ch = changes.where(_role_reason().isNull())
    ch = ch.withColumn("_k", F.lower(F.trim("email"))).withColumn("role_group", F.lower(F.trim("role_group")))
    ch = ch.withColumn("first_name", blank_to_null("first_name")).withColumn("last_name", blank_to_null("last_name"))
    ch = O.first_per_key(ch, ["_k"], [(c, True) for c in order])
    granted = F.create_map(*[x for r, p in R.ROLE_GROUPS.items()
                             for x in (F.lit(r), F.array(*[F.lit(v) for v in sorted(set(p))]))])
    ch = ch.withColumn("permissions", F.coalesce(F.element_at(granted, F.col("role_group")),
                                                 F.array().cast("array<string>")))
    cols = ["first_name", "last_name", "role_group", "permissions", "is_active"]
    t = target.withColumn("_k", F.lower(F.col("email"))).alias("t")
    s = ch.select("_k", *[F.col(c).alias(f"_s_{c}") for c in cols], F.col("actor").alias("_s_actor"),
                  F.lit(True).alias("_s_hit")).alias("s")
    j = t.join(s, "_k", "full_outer")
    new = F.col("email").isNull()
    upd = F.col("email").isNotNull() & F.coalesce(F.col("_s_hit"), F.lit(False))
    out = j.select(
        F.coalesce(F.col("email"), F.col("_k")).alias("email"),
        *[F.when(upd | new, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(new, _ts(as_of)).otherwise(F.col("created_at")).alias("created_at"),
        F.when(new, F.col("_s_actor")).otherwise(F.col("created_by")).alias("created_by"),
        F.when(upd | new, _ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(upd | new, F.col("_s_actor")).otherwise(F.col("updated_by")).alias("updated_by"),
        upd.alias("_upd"), new.alias("_new"))
    counts = _with_counts(out, updated=F.col("_upd"), inserted=F.col("_new"))
    return out.drop("_upd", "_new").select(*target.columns), counts


def seed_absent(target: DataFrame, seeds: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """R2: insert seed rows whose key is absent."""
    add = seeds.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(add, allowMissingColumns=True), add.agg(F.count(F.lit(1)).alias("inserted"))


def raise_floor(counters: DataFrame, floors: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """next_value = greatest(next_value, floor) per (counter_name, scope); missing
    counters are inserted at the floor. Floors are pre-aggregated by max."""
    f = floors.groupBy("counter_name", "scope").agg(F.max("next_value").alias("_floor"))
    j = counters.join(f, ["counter_name", "scope"], "full_outer")
    raised = F.col("_floor").isNotNull() & (F.col("next_value").isNull() | (F.col("_floor") > F.col("next_value")))
    out = j.select("counter_name", "scope",
                   F.when(raised, F.col("_floor")).otherwise(F.col("next_value")).alias("next_value"),
                   F.when(raised, _ts(as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
                   raised.alias("_r"), F.col("next_value").isNull().alias("_i"))
    counts = _with_counts(out, raised=F.col("_r") & ~F.col("_i"), inserted=F.col("_i"))
    return out.drop("_r", "_i"), counts


def last_per_key(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change per key by those of the ``order`` columns that the batch has; equal
    changes are ranked by their values, so one remains in any case."""
    by = [c for c in order if c in changes.columns] or [c for c in changes.columns if c not in key]
    return O.first_per_key(changes, key, [(c, True) for c in by])


def _patch(target: DataFrame, changes: DataFrame, key: list[str], value_of, as_of,
           stamp: bool = True, active_only: bool = False, by: bool = True, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Left join target with its changes (one per key) and rewrite columns; ``active_only``
    leaves inactive rows alone, ``by`` also stamps the actor. With ``named`` (the keys of the changes, of any
    number of rows each) target rows that have no change are not shuffled."""
    ch = changes.select(*key, *[F.col(c).alias(f"_s_{c}") for c in changes.columns if c not in key],
                        F.lit(True).alias("_hit"))
    near, far = (target, None) if named is None else split_by_keys(target, named, key)
    j = near.join(ch, key, "left")
    if far is not None:
        j = j.unionByName(far, allowMissingColumns=True)
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if active_only:
        hit = hit & F.coalesce(F.col("is_active"), F.lit(False))
    cols = []
    for c in target.columns:
        v = value_of(c, hit)
        if stamp and c == "updated_at":
            v = F.when(hit, _ts(as_of)).otherwise(F.col(c))
        elif stamp and by and c == "updated_by" and "_s_actor" in j.columns:
            v = F.when(hit, F.col("_s_actor")).otherwise(F.col(c))
        cols.append((v if v is not None else F.col(c)).alias(c))
    out = j.select(*cols, hit.alias("_hit"))
    return out.drop("_hit"), _with_counts(out, updated=F.col("_hit"))


# The editable columns of bags and products.
BAG_PATCH_COLUMNS = [
    "remaining_mass_kg", "short_moisture_percent", "purpose", "reference_sample_taken", "qc_status",
    "long_moisture_status", "density_status", "injection_moulding_status", "film_forming_status",
    "long_moisture_assignee_email", "density_assignee_email", "injection_moulding_assignee_email",
    "film_forming_assignee_email", "notes", "customer",
]
PRODUCT_PATCH_COLUMNS = [
    "storage_location", "notes", "number_units_produced", "numbered_in_order", "tensile_rigid_status",
    "tensile_films_status", "seal_strength_status", "shelf_stability_status", "solubility_status",
    "defect_analysis_status", "blocking_status", "film_emc_status", "friction_status", "width_mm", "length_m",
    "avg_film_thickness_um", "sd_film_thickness", "film_thickness_variation_percent",
]
ORDER = ["submitted_at"]


def patch_keep_null(target: DataFrame, changes: DataFrame, key: list[str], cols: list[str],
                    as_of, order: list[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """``col = COALESCE(new, old)`` for each listed column that the batch carries (NULL
    means keep), active rows only. Several changes of a key act one after the other, so each
    column gets its last non-NULL value; the actor is that of the last change."""
    present = [c for c in cols if c in changes.columns]
    by = [c for c in order if c in changes.columns] or [c for c in changes.columns if c not in key]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*by))).alias(c) for c in present]
    actor = [F.max_by("actor", F.struct(*by)).alias("actor")] if "actor" in changes.columns else []
    ch = changes.groupBy(*key).agg(*last, *actor)

    def value_of(c, hit):
        return F.when(hit, F.coalesce(F.col(f"_s_{c}"), F.col(c))).otherwise(F.col(c)) if c in present else None
    return _patch(target, ch, key, value_of, as_of, active_only="is_active" in target.columns, named=changes.select(*key))


def patch_bags(bags: DataFrame, changes: DataFrame, as_of, key: list[str],
               order: list[str] = ORDER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """R4 for bags: keep-null patch of the editable columns; changes to a negative remaining mass are
    refused. Returns (new bags, rejects, counts)."""
    negative = F.coalesce(F.col("remaining_mass_kg") < 0, F.lit(False)) if "remaining_mass_kg" in changes.columns else F.lit(False)
    new, counts = patch_keep_null(bags, changes.where(~negative), key, BAG_PATCH_COLUMNS, as_of, order)
    rejects = changes.where(negative).select(*key, F.lit("bounds_remaining_mass_kg").alias("rule"),
                                             F.lit("remaining_mass_kg must be >= 0").alias("message"))
    return new, rejects, counts


def patch_columns(target: DataFrame, changes: DataFrame, key: list[str], editable: list[str], as_of,
                  overwrite_all: bool = False, order: list[str] = ORDER) -> tuple[DataFrame, DataFrame]:
    """Overwrite the editable columns present in ``changes`` (NULL overwrites), active rows
    only; absent columns stay. The last change of a key wins. ``overwrite_all`` also NULLs
    editable columns the change did not carry (quirk K6 of the reference's product patch)."""
    present = set(changes.columns)
    changes = last_per_key(changes, key, order)

    def value_of(c, hit):
        if c not in editable:
            return None
        if c in present:
            return F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c))
        return F.when(hit, F.lit(None).cast(target.schema[c].dataType)).otherwise(F.col(c)) if overwrite_all else None
    return _patch(target, changes, key, value_of, as_of, active_only="is_active" in target.columns)


def set_archived(batches: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Archive toggle; archived_at/by are set when archiving and cleared when not. The
    last change of a batch wins."""
    def value_of(c, hit):
        arch = F.col("_s_archived")
        if c == "archived":
            return F.when(hit, arch).otherwise(F.col(c))
        if c == "archived_at":
            return F.when(hit, F.when(arch, _ts(as_of))).otherwise(F.col(c))
        if c == "archived_by":
            return F.when(hit, F.when(arch, F.col("_s_actor"))).otherwise(F.col(c))
        return None
    key = ["sku", "ingredient_batch_code"]
    return _patch(batches, last_per_key(changes, key, ORDER), key, value_of, as_of)


def update_status(bags: DataFrame, changes: DataFrame, assignees: DataFrame, as_of,
                  order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Status + assignee update on one whitelisted stream per change.

    A change is rejected when the column is not editable (P12), the repaired value is not
    in the stream's vocabulary (Q4), the assignee is not an active assignee (Q9), or it
    does not match exactly one active bag. Accepted changes are applied last-wins per
    (bag, column). Returns (new bags, rejects, counts)."""
    editable = R.EDITABLE_STATUS_COLUMNS
    vocab = F.create_map(*[x for c in editable for x in (F.lit(c), F.array(*[F.lit(v) for v in R.STATUS_VOCAB[c]]))])
    ch = changes.withColumn("_value", repair_status("status_value")) \
                .withColumn("_assignee", blank_to_null("assigned_value"))
    active_emails = assignees.where("is_active").select(F.col("email").alias("_assignee"), F.lit(True).alias("_ok_a"))
    matches = bags.where("is_active").groupBy("pellet_bag_code").agg(F.count(F.lit(1)).alias("_n"))
    ch = ch.join(active_emails, "_assignee", "left").join(matches, "pellet_bag_code", "left")
    reason = (F.when(~F.col("status_column").isin(*editable), F.lit("invalid_status_column"))
              .when(F.col("_value").isNull() | ~F.array_contains(F.element_at(vocab, F.col("status_column")),
                                                                  F.col("_value")), F.lit("invalid_status_value"))
              .when(F.col("_assignee").isNotNull() & F.col("_ok_a").isNull(), F.lit("invalid_assignee"))
              .when(F.coalesce(F.col("_n"), F.lit(0)) != 1, F.lit("not_exactly_one_row")))
    ch = ch.withColumn("reason", reason)
    rejects = ch.where("reason IS NOT NULL").select(*changes.columns, "reason")
    # the last change of each column, per bag in one aggregate (partial in each task)
    last = F.struct("_value", "_assignee", "actor")
    piv = ch.where("reason IS NULL").groupBy("pellet_bag_code").agg(
        *[F.max_by(last, F.when(F.col("status_column") == c, F.struct(*order, last))).alias(f"_p_{c}") for c in editable])
    piv = piv.withColumn("_actor", F.greatest(*[F.col(f"_p_{c}")["actor"] for c in editable]))
    j = bags.join(piv.withColumn("_hit", F.lit(True)), "pellet_bag_code", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("is_active")
    cols = []
    for c in bags.columns:
        v = F.col(c)
        for s in editable:
            a = R.STATUS_ASSIGNEE[s]
            p = F.col(f"_p_{s}")
            if c == s:
                v = F.when(hit & p.isNotNull(), p["_value"]).otherwise(F.col(c))
            elif c == a:
                v = F.when(hit & p.isNotNull(), p["_assignee"]).otherwise(F.col(c))
        if c == "updated_at":
            v = F.when(hit, _ts(as_of)).otherwise(F.col(c))
        if c == "updated_by":
            v = F.when(hit, F.col("_actor")).otherwise(F.col(c))
        cols.append(v.alias(c))
    out = j.select(*cols, hit.alias("_hit"))
    return out.drop("_hit"), rejects, _with_counts(out, updated=F.col("_hit"))


def update_hows(hows: DataFrame, changes: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Overwrite the editable fields of active compounding hows (blank -> NULL); the last
    change of a code wins."""
    editable = ["failure_mode", "machine_setup_url", "processed_data_url", "notes"]
    ch = changes.select("processing_code", "actor", *[c for c in ORDER if c in changes.columns],
                        *[(blank_to_null(c) if c != "failure_mode" else F.col(c)).alias(c) for c in editable])
    return patch_columns(hows, ch, ["processing_code"], editable, as_of)


def update_set_meta(sets: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and workstream overwritten by the last change of a set; ``created_by =
    COALESCE(created_by, updater)``, where the first updater fills a NULL."""
    key = ["set_code"]
    by = [c for c in ORDER if c in changes.columns] or [c for c in changes.columns if c not in key]
    filler = changes.groupBy(*key).agg(F.min_by("actor", F.when(F.col("actor").isNotNull(), F.struct(*by))).alias("actor"))
    changes = last_per_key(changes.select(*key, "notes", "material_workstream", *[c for c in by if c not in ("notes", "material_workstream")]),
                           key, ORDER).drop("actor").join(filler, key)

    def value_of(c, hit):
        if c in ("notes", "material_workstream"):
            return F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c))
        if c == "created_by":
            return F.when(hit, F.coalesce(F.col(c), F.col("_s_actor"))).otherwise(F.col(c))
        return None
    return _patch(sets, changes, ["set_code"], value_of, None, stamp=False)


DOCUMENT_COLUMNS = {
    "msds": {"object_path": "msds_object_path", "filename": "msds_filename", "content_type": "msds_content_type",
             "uploaded_at": "msds_uploaded_at"},
    "spec": {"object_path": "spec_object_path", "uploaded_at": "spec_uploaded_at"},
}


def set_document(target: DataFrame, pointers: DataFrame, key: list[str], kind: str,
                 as_of) -> tuple[DataFrame, DataFrame]:
    """Point each row at its newest uploaded document (O5 by uploaded_at, then path). A safety
    sheet stamps its actor, a batch's spec sheet the time only."""
    latest = O.first_per_key(pointers, key, [("uploaded_at", True), ("object_path", True)])
    mapping = DOCUMENT_COLUMNS[kind]
    ch = latest.select(*key, *[F.col(src).alias(dst) for src, dst in mapping.items()],
                       *([F.col("actor")] if "actor" in latest.columns else []))

    def value_of(c, hit):
        return F.when(hit, F.col(f"_s_{c}")).otherwise(F.col(c)) if c in mapping.values() else None
    return _patch(target, ch, key, value_of, as_of, by=kind != "spec")


def delete_sets(sets: DataFrame, items: DataFrame, codes: DataFrame,
                deps: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete sets and their items unless they have dependants. ``deps`` is
    (set_code, source, n) (A7); a blocked set is rejected with 'source=n, ...'."""
    req = codes.select("set_code").distinct()
    blocked = deps.join(req, "set_code", "left_semi").where("n > 0").groupBy("set_code").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "source", F.col("n").cast("string")))), ", ")
        .alias("reason"))
    allowed = pin(req.join(blocked, "set_code", "left_anti"))
    return (anti_join(sets, allowed, ["set_code"]), anti_join(items, allowed, ["set_code"]),
            blocked.withColumn("rule", F.lit("has_dependants")))


def seed_if_empty(target: DataFrame, defaults: DataFrame) -> DataFrame:
    """Add default rows only when the target has no active row (one-row flag join)."""
    flag = target.where("is_active").agg((F.count(F.lit(1)) == 0).alias("_empty"))
    return target.unionByName(defaults.crossJoin(flag).where("_empty").drop("_empty"), allowMissingColumns=True)
