"""Stored intermediate tables and table reading for the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from batchtrace.session import checkpoint_dir, ship  # noqa: F401  (ship: for the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Where the paths of tables stored by the current call go, if anyone wants them.
_STORED: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("stored", default=None)
#: Column metadata that names the stored tables which a result still reads.
TABLES = "stored_tables"

#: Word rule of every contract: a run without ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from any path it can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame) -> list[Column]:
    """The table's columns, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the cluster's shared folder (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what lies before, and
    several readers share one evaluation (row ids and samples in it are fixed)."""
    spark = df.sparkSession
    path = scratch(spark, label)
    if (stored := _STORED.get()) is not None:
        stored.append(path)
    # small row groups: a task that writes whole texts buffers one group in memory
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a stored table that no later plan reads (superseded rounds of an iteration)."""
    if isinstance(df_or_path, DataFrame):
        spark = df_or_path.sparkSession
        paths = {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    else:
        paths = {df_or_path}
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def storing():
    """The paths of the tables that are stored inside the block (by this thread)."""
    token = _STORED.set([])
    try:
        yield _STORED.get()
    finally:
        _STORED.reset(token)


def keeping_tables(operator):
    """The result of ``operator`` names the tables stored for it in its first column's metadata, which
    also goes into files that it is written to: see ``tables_of`` and ``release``."""
    @functools.wraps(operator)
    def run(*args, **named) -> DataFrame:
        with storing() as paths:
            out = operator(*args, **named)
        return naming(out, paths)
    return run


def naming(df: DataFrame, paths: list[str]) -> DataFrame:
    """``df`` with these stored tables named in its first column's metadata (instead of any others)."""
    first, *rest = df.columns
    return df.select(F.col(f"`{first}`").alias(first, metadata={TABLES: paths}), *[F.col(f"`{c}`") for c in rest])


def tables_of(df: DataFrame) -> list[str]:
    """The stored tables that a result of ``keeping_tables``, or a copy of it read from files, names."""
    return [p for f in df.schema.fields for p in f.metadata.get(TABLES, [])]


def release(df: DataFrame) -> None:
    """Delete the tables that a written and reread copy of a result names. Nothing is deleted if ``df`` itself
    reads any of them: then it is the result, which others may read too (see ``forget``)."""
    named = tables_of(df)
    files = df.inputFiles() if named else []
    if not any(p.rsplit("/", 1)[1] in f for p in named for f in files):
        for path in named:
            delete(path, df.sparkSession)


def forget(df: DataFrame) -> None:
    """Delete all tables that a result names; it can't be read afterwards."""
    for path in tables_of(df):
        delete(path, df.sparkSession)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a whole text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")
