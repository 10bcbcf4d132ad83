"""Token-count rollups kept up to date by deltas.

Changes arrive in batches of before/after images. A batch becomes signed sums per source, language
and tokenizer version (insert: plus, delete: minus, revise: both), written as one Parquet folder
``batch=<id>`` whose ``_SUCCESS`` file is its commit. Totals are the sum of all committed batches,
so a batch that is sent again changes nothing and a broken one leaves nothing behind.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from batchtrace.llm.shared import ship
from batchtrace.llm.tokens import byte_tokens, word_tokens

#: Tokenizer version -> vocabulary file and encoder.
VERSIONS = {"word_bpe_49k": ("word_bpe_49k.json", word_tokens), "byte_bpe_50k": ("byte_bpe_50k.tiktoken", byte_tokens)}
IMAGE = "struct<text: string, source: string, lang: string>"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens"]


def count_tokens(text: Column, versions: tuple[str, ...]) -> Column:
    """array<long>: tokens of whole texts under each version (null and empty: 0)."""

    @F.pandas_udf("array<long>")
    def counts(texts: pd.Series) -> pd.Series:
        encoders = [VERSIONS[v][1](VERSIONS[v][0]) for v in versions]
        return pd.Series([[e.count(t) for e in encoders] for t in texts], dtype=object)

    return counts(text)


def deltas(changes: DataFrame, versions: tuple[str, ...] = tuple(VERSIONS)) -> DataFrame:
    """Signed sums (source, lang, tokenizer, n_docs, n_tokens) of change rows op, before, after.

    An insert counts its after image, a delete its before image, a revise both; a null or unknown
    op and a null image count nothing. Null text has no tokens but is a document; null source and
    lang are groups of their own. Repeated rows count each; other columns are ignored. Partial
    sums come before the shuffle, so a hot group is one row a task.
    """
    ship(changes.sparkSession)
    minus = F.struct(F.lit(-1).cast("long").alias("sign"), F.col("before").cast(IMAGE).alias("image"))
    plus = F.struct(F.lit(1).cast("long").alias("sign"), F.col("after").cast(IMAGE).alias("image"))
    signed = F.when(F.col("op") == "insert", F.array(plus)).when(F.col("op") == "delete", F.array(minus)).when(
        F.col("op") == "revise", F.array(minus, plus))
    images = changes.select(F.explode(signed).alias("s")).where("s.image is not null").select("s.sign", "s.image.*")
    counted = images.select("source", "lang", "sign", count_tokens(F.col("text"), versions).alias("n"))
    each = F.arrays_zip(F.array(*[F.lit(v) for v in versions]).alias("tokenizer"), F.col("n"))
    rows = counted.select("source", "lang", "sign", F.explode(each).alias("t"))
    return (rows.select("source", "lang", F.col("t.tokenizer").alias("tokenizer"), "sign", F.col("t.n").alias("n"))
            .groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).alias("n_tokens")))


def _folders(spark: SparkSession, root: str) -> dict[int, bool]:
    """Batch ids below ``root`` and whether they are committed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return {int(p.getName().split("=")[1]): fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
            for p in names if p.getName().startswith("batch=")}


def commit(changes: DataFrame, root: str, batch: int, versions: tuple[str, ...] = tuple(VERSIONS)) -> bool:
    """Add a batch to the rollup at ``root``; False, without any work, if it is committed already.

    Folders of broken attempts are overwritten. One writer a batch id at a time."""
    if _folders(changes.sparkSession, root).get(batch):
        return False
    deltas(changes, versions).write.mode("overwrite").parquet(f"{root}/batch={batch}")
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """source, lang, tokenizer, n_docs, n_tokens over all committed batches; groups that come to zero go."""
    schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
    done = [f"{root}/batch={b}" for b, ok in sorted(_folders(spark, root).items()) if ok]
    rows = spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
    return (rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0"))
