"""A13 from the run itself: every job of a request is timed and its rows counted while it runs.

The counts come from ``DataFrame.observe`` on the job's own plan, so nothing runs twice. Log rows are
committed to the table ``query_log`` and summed per request by ``aggregates.query_cost_rollup``.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from batchtrace.sources.commits import APPEND, TableStore, change_tables
from batchtrace.sources.schemas import SCHEMAS

TABLE = "query_log"
LOG = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("query_id", T.StringType()),
                    T.StructField("name", T.StringType()), T.StructField("elapsed_ms", T.DoubleType()),
                    T.StructField("rows", T.LongType()), T.StructField("failed", T.BooleanType()),
                    T.StructField("logged_at", T.TimestampNTZType())])


class RequestLog:
    """The jobs of one request; ``close`` commits their log rows under the request's id."""

    def __init__(self, spark: SparkSession, root: str, request_id: str):
        self.spark, self.root, self.request_id, self.rows = spark, root, request_id, []

    def run(self, name: str, df: DataFrame, action: Callable[[DataFrame], object]):
        """``action(df)``, timed and counted; a failing job is logged without rows and raises."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        began, n, failed = time.monotonic(), None, True
        try:
            out = action(watched)
            n, failed = seen.get["rows"], False
            return out
        finally:
            self.rows.append((self.request_id, uuid.uuid4().hex, name, (time.monotonic() - began) * 1000, n, failed))

    def close(self) -> None:
        rows, self.rows = self.rows, []
        log = self.spark.createDataFrame([(*r, None) for r in rows], LOG).withColumn("logged_at", F.localtimestamp().cast("timestamp_ntz"))
        change_tables(self.spark, self.root, lambda _: {TABLE: (APPEND, log)}, key=f"request/{self.request_id}", make=log_store)

    def __enter__(self):
        return self

    def __exit__(self, *failure) -> None:
        self.close()


def log_store(spark: SparkSession, root: str) -> TableStore:
    return TableStore(spark, root, schemas=SCHEMAS | {TABLE: LOG})
