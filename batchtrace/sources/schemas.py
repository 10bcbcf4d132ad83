"""Typed base tables (S1), additive schema evolution (S4), null backfill (S5),
required-schema check (S6) and snapshot writes.

Timestamps are UTC wall-clock values stored as ``timestamp_ntz`` so results do not
depend on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from batchtrace.session import at_most

S, L, D, B, TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()
WT = T.DecimalType(38, 9)
ARR_S = T.ArrayType(T.StringType())


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


def _req(name, t):
    return (name, t, False)


def _opt(name, t):
    return (name, t, True)


_AUDIT = [_req("created_at", TS), _req("updated_at", TS), _opt("created_by", S), _opt("updated_by", S)]

_BAG_STATUS = ["long_moisture", "density", "injection_moulding", "film_forming"]
_PRODUCT_STATUS = ["tensile_rigid", "tensile_films", "seal_strength", "shelf_stability", "solubility",
                   "defect_analysis", "blocking", "film_emc", "friction"]

SCHEMAS: dict[str, T.StructType] = {
    "ingredients": _schema(
        _req("sku", S), _req("category_code", L), _req("seq", L), _req("pack_size_value", L),
        _req("pack_size_unit", S), _req("trade_name_inci", S), _req("supplier", S), _opt("spec_grade", S),
        _req("format", S), *_AUDIT, _req("is_active", B), _opt("msds_object_path", S),
        _opt("msds_filename", S), _opt("msds_content_type", S), _opt("msds_uploaded_at", TS)),
    "ingredient_batches": _schema(
        _req("sku", S), _req("ingredient_batch_code", S), _opt("received_at", TS), _opt("notes", S),
        _opt("quantity_value", D), _opt("quantity_unit", S), *_AUDIT, _req("is_active", B),
        _opt("spec_object_path", S), _opt("spec_uploaded_at", TS), _opt("archived", B),
        _opt("archived_at", TS), _opt("archived_by", S)),
    "ingredient_sets": _schema(
        _req("set_code", S), _req("set_hash", S), _req("created_at", TS), _opt("created_by", S),
        _opt("notes", S), _opt("material_workstream", S)),
    "ingredient_set_items": _schema(
        _req("set_code", S), _req("sku", S), _req("created_at", TS), _opt("created_by", S)),
    "dry_weight_variants": _schema(
        _req("set_code", S), _req("weight_code", S), _req("weight_hash", S), _req("created_at", TS),
        _opt("created_by", S), _opt("notes", S)),
    "dry_weight_items": _schema(
        _req("set_code", S), _req("weight_code", S), _req("sku", S), _req("wt_percent", WT),
        _req("created_at", TS), _opt("created_by", S)),
    "batch_variants": _schema(
        _req("set_code", S), _req("weight_code", S), _req("batch_variant_code", S), _req("batch_hash", S),
        _req("created_at", TS), _opt("created_by", S), _opt("notes", S)),
    "batch_variant_items": _schema(
        _req("set_code", S), _req("weight_code", S), _req("batch_variant_code", S), _req("sku", S),
        _req("ingredient_batch_code", S), _req("created_at", TS), _opt("created_by", S)),
    "code_counters": _schema(
        _req("counter_name", S), _req("scope", S), _req("next_value", L), _req("updated_at", TS)),
    "audit_log": _schema(
        _req("event_id", S), _req("event_type", S), _opt("actor", S), _req("event_at", TS),
        _req("entity_type", S), _req("entity_id", S), _opt("payload_json", S)),
    "location_partners": _schema(
        _req("partner_code", S), _req("partner_name", S), _opt("machine_specification", S),
        _req("created_at", TS), _opt("created_by", S)),
    "location_codes": _schema(
        _req("set_code", S), _req("weight_code", S), _req("batch_variant_code", S), _req("partner_code", S),
        _req("production_date", S), _req("location_id", S), _req("created_at", TS), _opt("created_by", S)),
    "compounding_how": _schema(
        _req("processing_code", S), _req("location_code", S), _req("process_code_suffix", S),
        _req("failure_mode", S), _opt("machine_setup_url", S), _opt("processed_data_url", S),
        _opt("notes", S), *_AUDIT, _req("is_active", B)),
    "pellet_bags": _schema(
        _req("pellet_bag_id", S), _req("pellet_bag_code", S), _opt("pellet_bag_code_tokens", ARR_S),
        _req("compounding_how_code", S), _req("product_type", S), _req("sequence_number", L),
        _req("bag_mass_kg", D), _req("remaining_mass_kg", D), _opt("short_moisture_percent", D),
        _opt("purpose", S), _opt("reference_sample_taken", S), _opt("qc_status", S),
        *[_opt(f"{s}_status", S) for s in _BAG_STATUS],
        *[_opt(f"{s}_assignee_email", S) for s in _BAG_STATUS],
        _opt("notes", S), _opt("customer", S), *_AUDIT, _req("is_active", B)),
    "pellet_bag_assignees": _schema(
        _req("email", S), _req("is_active", B), _req("created_at", TS), _opt("created_by", S)),
    "conversion1_context": _schema(
        _req("context_code", S), _req("pellet_bag_code", S), _req("partner_code", S), _req("machine_code", S),
        _req("date_yymmdd", S), _req("created_at", TS), _opt("created_by", S), _req("updated_at", TS),
        _opt("updated_by", S), _req("is_active", B)),
    "conversion1_how": _schema(
        _req("conversion1_how_code", S), _req("context_code", S), _opt("process_code", S),
        _req("processing_code", S), _opt("failure_mode", S), _opt("machine_setup_url", S),
        _opt("processed_data_url", S), _req("created_at", TS), _opt("created_by", S), _opt("updated_at", TS),
        _opt("updated_by", S), _req("is_active", B)),
    "conversion1_products": _schema(
        _req("product_code", S), _req("conversion1_how_code", S), _req("product_suffix", S),
        _opt("storage_location", S), _opt("notes", S), _opt("number_units_produced", L),
        _opt("numbered_in_order", B), *[_opt(f"{s}_status", S) for s in _PRODUCT_STATUS],
        _opt("width_mm", L), _opt("length_m", L), _opt("avg_film_thickness_um", L),
        _opt("sd_film_thickness", D), _opt("film_thickness_variation_percent", D),
        _req("created_at", TS), _opt("created_by", S), _opt("updated_at", TS), _opt("updated_by", S),
        _req("is_active", B)),
    "conversion1_product_counter": _schema(
        _req("id", S), _req("next_suffix", L), _req("updated_at", TS)),
    "user_roles": _schema(
        _req("email", S), _opt("first_name", S), _opt("last_name", S), _req("role_group", S),
        _opt("permissions", ARR_S), _req("is_active", B), _req("created_at", TS), _opt("created_by", S),
        _opt("updated_at", TS), _opt("updated_by", S)),
}

# Natural keys: stored snapshots are sorted by them inside each file, so Parquet min/max
# statistics let equality and range filters on codes skip row groups.
TABLE_KEYS: dict[str, list[str]] = {
    "ingredients": ["sku"],
    "ingredient_batches": ["sku", "ingredient_batch_code"],
    "ingredient_sets": ["set_code"],
    "ingredient_set_items": ["set_code", "sku"],
    "dry_weight_variants": ["set_code", "weight_code"],
    "dry_weight_items": ["set_code", "weight_code", "sku"],
    "batch_variants": ["set_code", "weight_code", "batch_variant_code"],
    "batch_variant_items": ["set_code", "weight_code", "batch_variant_code", "sku"],
    "code_counters": ["counter_name", "scope"],
    "location_partners": ["partner_code"],
    "location_codes": ["location_id"],
    "compounding_how": ["processing_code"],
    "pellet_bags": ["pellet_bag_code"],
    "pellet_bag_assignees": ["email"],
    "conversion1_context": ["context_code"],
    "conversion1_how": ["conversion1_how_code"],
    "conversion1_products": ["product_code"],
    "conversion1_product_counter": ["id"],
    "user_roles": ["email"],
}

BAG_STATUS_STREAMS = tuple(_BAG_STATUS)
PRODUCT_STATUS_STREAMS = tuple(_PRODUCT_STATUS)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Typed scan of one base table (no inference, no footer merge) as its newest version has it."""
    return Tables(spark, root)[name]


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive evolution. Columns missing from ``df`` are added as typed NULLs;
    present columns are cast to the contract type; the result has the contract order."""
    have = set(df.columns)
    return df.select([
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def backfill(df: DataFrame, col: str, value) -> DataFrame:
    """Migration backfill, e.g. ``archived IS NULL -> FALSE``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def require_schema(spark: SparkSession, frames: dict[str, DataFrame],
                   contract: dict[str, list[str]] | None = None, check_nulls: bool = True) -> DataFrame:
    """Compare the frames with the table contract and report every problem at once:
    one row per (table_name, column_name, problem). Missing tables and columns come from
    the schemas (plan-time metadata); with ``check_nulls`` each table is also scanned once
    (one aggregate, partial per task) for NULLs in its NOT NULL columns."""
    contract = contract or {name: [f.name for f in SCHEMAS[name].fields] for name in frames}
    rows = []
    for table, cols in sorted(contract.items()):
        if table not in frames:
            rows.append((table, None, "missing_table"))
            continue
        have = set(frames[table].columns)
        rows.extend((table, c, "missing_column") for c in cols if c not in have)
    out = spark.createDataFrame(rows, "table_name string, column_name string, problem string")
    if not check_nulls:
        return out
    for table in sorted(frames):
        if table not in SCHEMAS:
            continue
        required = [f.name for f in SCHEMAS[table].fields if not f.nullable and f.name in frames[table].columns]
        if not required:
            continue
        counts = frames[table].agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in required])
        stacked = counts.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in required])).alias("x"))
        out = out.unionByName(stacked.where("x.n > 0").select(
            F.lit(table).alias("table_name"), F.col("x.column_name").alias("column_name"),
            F.lit("null_in_required_column").alias("problem")))
    return out


def file_problems(spark: SparkSession, root: str, names: list[str] | None = None, threads: int = 16) -> DataFrame:
    """S6 against the stored files: table_name, file, column_name, problem, expected, found.

    The schema of every part file of the tables' newest version is read from its footer by Spark's
    Parquet reader, without the imposed contract, so a file that lacks a column, has it in another type
    or has a column more is found whatever the other files have. Problems: missing_table (no
    file), missing_column, wrong_type, extra_column. Only footers are read, several at once."""
    from concurrent.futures import ThreadPoolExecutor
    tables = Tables(spark, root)
    files = [(n, f) for n in names or sorted(SCHEMAS) for f in sorted(tables[n].inputFiles()) or [None]]

    def check(item: tuple[str, str | None]) -> list[tuple]:
        name, file = item
        if file is None:
            return [(name, None, None, "missing_table", None, None)]
        have = {f.name: f.dataType.simpleString() for f in spark.read.parquet(file).schema.fields}
        want = {f.name: f.dataType.simpleString() for f in SCHEMAS[name].fields}
        return [(name, file, c, "missing_column" if c not in have else "wrong_type", want[c], have.get(c))
                for c in want if have.get(c) != want[c]] + [(name, file, c, "extra_column", None, have[c]) for c in have if c not in want]

    with ThreadPoolExecutor(threads) as pool:
        rows = [r for found in pool.map(check, files) for r in found]
    return spark.createDataFrame(rows, "table_name string, file string, column_name string, problem string, expected string, found string")


def write_snapshot(df: DataFrame, root: str, name: str, snapshot: str) -> str:
    """Write ``df`` as a new snapshot folder of a table and return its path. Table changes never
    update files in place; readers go on with the old rows until ``publish`` switches them."""
    path = f"{root.rstrip('/')}/{name}/_snapshots/{snapshot}"
    write_clustered(df, name, path)
    return path


def publish(spark: SparkSession, root: str, snapshots: dict[str, str], version: int | None = None) -> bool:
    """Switch all readers to the written snapshots (table -> path) of one change at once. With
    ``version`` (of the store that the change was computed from), False if there is a newer one."""
    from batchtrace.sources.commits import REPLACE, TableStore
    store = TableStore(spark, root)
    if version is not None and store.version != version:
        return False
    return store.commit([(REPLACE, n, p.removeprefix(f"{store.root}/")) for n, p in snapshots.items()])


def clustered(df: DataFrame, name: str) -> DataFrame:
    """Sort rows by the table's natural key inside each output file (no shuffle)."""
    keys = [k for k in TABLE_KEYS.get(name, []) if k in df.columns]
    return df.sortWithinPartitions(*keys) if keys else df


#: Stored bytes, and shuffled bytes, that a task sorts at most: stored rows are 20 to 30 times that size in memory.
SORTED_BYTES = 16 << 20
#: Bytes of a row group, below which a file can't be split.
ROW_GROUP_BYTES = 8 << 20
FILE_OPTIONS = {"compression": "zstd", "parquet.block.size": str(ROW_GROUP_BYTES)}


def write_clustered(df: DataFrame, name: str, path: str, schema: T.StructType | None = None) -> None:
    """Write rows of a table, typed and sorted by its key in each file. A task takes a bounded share of the
    stored rows, so that its sort stays in memory however large the table is."""
    with at_most(df.sparkSession, {"spark.sql.files.maxPartitionBytes": SORTED_BYTES,
                                   "spark.sql.adaptive.advisoryPartitionSizeInBytes": SORTED_BYTES}):
        clustered(evolve(df, schema or SCHEMAS[name]), name).write.options(**FILE_OPTIONS).parquet(path)


def append_batch(df: DataFrame, root: str, name: str, batch_id: str | int) -> str:
    """S3, idempotent form: the rows of one registration batch are committed under the batch's id, so
    a batch that is repeated (also after its rows went into a snapshot) is not appended twice."""
    return _append(df, root, name, f"{name}/batch={batch_id}")


def append(df: DataFrame, root: str, name: str) -> str:
    """S3: append new rows to a table (typed to the table contract first). Readers that open the table
    afterwards see them."""
    return _append(df, root, name, None)


def _append(df: DataFrame, root: str, name: str, key: str | None) -> str:
    from batchtrace.sources.commits import APPEND, change_tables
    change_tables(df.sparkSession, root, lambda _: {name: (APPEND, df)}, key=key)
    return f"{root.rstrip('/')}/{name}"


def Tables(spark: SparkSession, root: str, version: int | None = None):
    """The stored tables under ``root`` as a lazy mapping name -> typed DataFrame, the form every plan
    function takes (``t["pellet_bags"]`` or ``t.pellet_bags``), all as of one version."""
    from batchtrace.sources.commits import TableStore
    return TableStore(spark, root, version=version)
