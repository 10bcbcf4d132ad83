"""Access policy on data.

The role table is a fixed registry (5 roles, 24 permissions, about 90 rows) and is
broadcast; everything per user is a join, so policy applies to any number of users
and rows in one plan (row-level masking instead of one decision per request)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchtrace.functions.text import normalize_email
from batchtrace.sources import registries as R

DRY_WEIGHTS_VIEW = "dry_weights.view"


def role_permissions(spark: SparkSession) -> DataFrame:
    """(role_group, permission) pairs; unknown roles have none."""
    return R.role_table(spark)


def user_permissions(spark: SparkSession, roles: DataFrame) -> DataFrame:
    """X1 applied: one row per (email, permission) of each user's role (role names are
    matched trimmed and lower-cased; an unknown role yields no permission rows)."""
    rt = R.role_table(spark).withColumnRenamed("role_group", "_role")
    u = roles.select(F.lower(F.trim("email")).alias("email"), "role_group", "is_active",
                     F.lower(F.trim("role_group")).alias("_role"))
    return u.join(F.broadcast(rt), "_role", "inner").drop("_role")


def effective_access(spark: SparkSession, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Per user (``email`` column, provider prefix stripped, lower-cased): the permissions
    of the active role, looked up trimmed and lower-cased. Only the exact role ``admin`` makes
    an admin. When there is no active role at all, a user is a bootstrap admin with role
    ``admin``; a user without a role is ``unassigned``. Returns email, role_group, is_admin,
    is_bootstrap_admin, permissions (sorted array), can_view_dry_weights."""
    active = roles.where("is_active").select(F.lower("email").alias("email"), "role_group", F.lit(True).alias("_has"))
    n_active = roles.where("is_active").agg((F.count(F.lit(1)) == 0).alias("_bootstrap"))
    u = users.select(normalize_email("email").alias("email")).distinct()
    j = u.join(active, "email", "left").crossJoin(n_active)
    perms = R.role_table(spark).groupBy("role_group").agg(F.sort_array(F.collect_list("permission")).alias("_p"))
    boot = F.col("_has").isNull() & F.col("_bootstrap")
    role = F.when(boot, F.lit("admin")).otherwise(F.coalesce("role_group", F.lit("")))
    j = j.withColumn("_boot", boot).withColumn("_role", role).withColumn("_key", F.lower(F.trim("_role")))
    j = j.join(F.broadcast(perms.withColumnRenamed("role_group", "_key")), "_key", "left")
    p = F.coalesce(F.col("_p"), F.array().cast("array<string>"))
    return j.select("email", F.when(F.col("_role") == "", "unassigned").otherwise(F.col("_role")).alias("role_group"),
                    (F.col("_role") == "admin").alias("is_admin"), F.col("_boot").alias("is_bootstrap_admin"),
                    p.alias("permissions"), F.array_contains(p, DRY_WEIGHTS_VIEW).alias("can_view_dry_weights"))


def mask_weights(forms: DataFrame, can_view: bool | None = None, flag_col: str | None = None,
                 col: str = "dry_weight_items") -> DataFrame:
    """Drop the dry-weight column for a viewer without ``dry_weights.view``
    (``can_view``), or mask it per row from a boolean column (``flag_col``)."""
    if flag_col is not None:
        return forms.withColumn(col, F.when(F.col(flag_col), F.col(col)))
    return forms if can_view else forms.drop(col)


def mask_section(df: DataFrame, viewers: DataFrame, permission: str) -> DataFrame:
    """The section's rows for each viewer (``df`` has their email in ``viewer``) who holds
    ``permission``; the section is empty for the others. ``viewers`` has email, permissions."""
    may = viewers.where(F.array_contains("permissions", permission)).select(F.col("email").alias("viewer"))
    return df.join(may.distinct(), "viewer", "left_semi")


def union_permissions(a, b) -> F.Column:
    """U4: union of two permission arrays, deduplicated and sorted (NULL counts as empty)."""
    empty = F.array().cast("array<string>")
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty)))
