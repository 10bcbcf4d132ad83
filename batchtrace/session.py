"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings every job in this package assumes: UTC clock, AQE on (runtime
# coalescing and skew-join splitting), Arrow for the few pandas UDFs.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Cluster profile for the 100 TB target: start with many shuffle partitions and let AQE
# coalesce them to ~256 MB; split partitions that are 5x the median and over 512 MB; keep
# automatic broadcasts to genuinely small sides; let Parquet splits stay at 256 MB.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "batchtrace", extra: dict | None = None, profile: str = "local") -> SparkSession:
    """Session with the package defaults; ``profile="cluster"`` adds CLUSTER_CONF (the
    shared ``spark.checkpoint.dir`` must come from the deployment)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the folder is configured by the deployment and is read from the
    session (a cluster session without it is an error: a machine-local folder would not
    survive a lost executor). Only a local-mode session without the setting (tests)
    gets a folder under /tmp.
    """
    sc = spark.sparkContext
    configured = (spark.conf.get("spark.checkpoint.dir", None)
                  or sc.getConf().get("spark.checkpoint.dir", None)
                  or sc.getCheckpointDir())
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store) for cluster runs")
    local = tempfile.mkdtemp(prefix="batchtrace-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # core conf may be read-only at runtime; the context setting suffices
        pass
    spark.sparkContext.setCheckpointDir(local)
    return local


@contextlib.contextmanager
def at_most(spark: SparkSession, most: dict[str, int]):
    """Hold size settings (key -> bytes) at ``most`` inside the block, where the session has more."""
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    was = {k: spark.conf.get(k) for k in most}
    was = {k: v for k, v in was.items() if to_bytes(v) > most[k]}
    try:
        for k in was:
            spark.conf.set(k, str(most[k]))
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors' Python workers, once per application, so that
    pandas UDFs work whether or not the package is installed there."""
    sc = spark.sparkContext
    if _SHIPPED.get("app") == sc.applicationId:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="batchtrace-code-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "batchtrace_code"), "zip",
                                     os.path.dirname(package), os.path.basename(package)))
    _SHIPPED["app"] = sc.applicationId


#: Pinned frames in small row groups, which a later scan can split.
PIN_OPTIONS = {"compression": "zstd", "parquet.block.size": str(8 << 20)}


def pin(df):
    """Write ``df`` to ``spark.checkpoint.dir`` and return it as read back: cuts lineage before a frame
    is used by several branches (no recomputation, and a lost executor recomputes nothing upstream).
    A compressed table is a fraction of a checkpoint's size, and each branch reads the columns that it
    needs only. A frame with a column that Parquet can't hold is checkpointed."""
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if any("void" in f.dataType.simpleString() for f in df.schema.fields):
        return df.checkpoint(eager=True)
    path = f"{folder.rstrip('/')}/pinned/{uuid.uuid4().hex}"
    df.write.options(**PIN_OPTIONS).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
