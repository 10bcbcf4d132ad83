"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
back as the next stage's docs; all but the last return the columns of ``docs``. Nulls, empty texts,
repeated rows and empty tables are handled as the operators' docstrings say.

A result names the tables that its stage stored (in the metadata of its first column, which goes into
the written files); the next stage deletes them, as it reads the written copy. No state is kept
between calls, so runs over several inputs may take turns.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from batchtrace.llm import exact, mix, pack, quality, simhash
from batchtrace.llm.queries import TARGETS, labelled_domains
from batchtrace.llm.shared import columns, delete, keeping_tables, naming, release, storing, store, table, tables_of


def _stage(stage):
    """A stage that deletes what its predecessor stored for ``docs``, and names what it stores itself."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs)
        return keeping_tables(stage)(spark, docs, sf_dir)
    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).where("kept").select(columns(docs))


@_stage
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact.exact_dedup(docs).where("kept").select(columns(docs))


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints."""
    return simhash.simhash_groups(docs, shingle=4, max_bits=4).where("kept").select(columns(docs))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says (copies 0, 1 or more)."""
    mixed = mix.mix(docs, labelled_domains(spark, sf_dir), TARGETS)
    copy = F.explode(F.expr("case when copies > 0 then sequence(1, copies) else cast(array() as array<int>) end"))
    return mixed.withColumn("_copy", copy).select(columns(docs))


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences."""
    return pack.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result names the tables that it reads."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with storing() as written:
            docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for path in last:
            delete(path, spark)
        last = written
    out = STAGES[-1][1](spark, docs, sf_dir)
    return naming(out, last + tables_of(out))


#: The classifier, the least squares fit and the packing have no SQL form; tests compare each stage by brute force.
ORACLE_SQL = None
